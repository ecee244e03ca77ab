"""BPE encoding and decoding through a distinct-word table (operator 1).

1. Split: each task cuts its documents into words as the tokenizer's own normalizer and pre-tokenizer do, and
   packs them into blocks of up to BLOCK_CHARS characters: for each document the positions as codes into the
   block's distinct words, and these words, dealt out by their hash into one packed row per hash bucket.  Blocks are
   written once to the shared checkpoint folder.
2. Distinct words: all words of a hash bucket meet in one task, bucket after bucket, which encodes each distinct word of
   the bucket once.  A word has at most one place per block, so a frequent word is no hot key.
3. Join back: the ids return to their block, bucket by bucket, and the codes put them in place.
4. Decode: ids become pieces through the id-to-piece table (the vocabulary, a fixed size), again once per
   distinct word of a block, and the pieces are joined by blanks, as the tokenizer does without a decoder.

A task holds one block (or one longer text) and the words of one bucket; results leave it in batches of about
OUT_CHARS characters.

The result equals ``Tokenizer.encode(text, add_special_tokens=False)`` and ``decode(ids,
skip_special_tokens=False)``; strings of special tokens in a text become their ids, as they do there.

Texts whose characters are all below U+0180 (but U+0130, whose lower case is two characters) take a direct pattern (NFC leaves them alone, and lower-casing and
classes are plain); any other text goes through the library's normalizer and split pattern.  A tokenizer file of another
build (``BUILD``: normalizer, pre-tokenizer, no unknown token, no decoder) is refused; vocabulary, merges and special
tokens are read from the file.

Defined results: null or empty text has no ids and decodes to the empty string; repeated rows give repeated
rows; extra columns are ignored; a null doc_id stays null; an empty table gives no rows; a text of any length is one
document of one block; the order of equal rows is not defined (rows carry no position).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table, texts, written

BLOCK_CHARS = 1 << 23
#: Characters of decoded text in one batch of results.
OUT_CHARS = 1 << 20

# The build of tokenizer file that the split below restates.
BUILD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}

LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = "\t-\r \x85\xa0"
PLAIN = re.compile(f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")
BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def checked(spec: str) -> str:
    """``spec`` if it is of the build that this operator restates; special tokens have to be found as they stand."""
    conf = json.loads(spec)
    other = [k for k, v in BUILD.items() if conf.get(k) != v]
    model = conf["model"]
    if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout"):
        other.append("model")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in conf["added_tokens"]):
        other.append("added_tokens")
    if other:
        raise ValueError(f"tokenizer file of another build: {', '.join(other)}")
    return spec


def splitter(spec: str) -> Callable[[str], list[str]]:
    """text -> words (normalised), with the special tokens of the text among them."""
    from tokenizers import Regex, pre_tokenizers

    tok, conf = load(spec), json.loads(spec)
    special = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
    at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    marks = tuple({t[:2] for t in special})
    pattern = next(p["pattern"]["Regex"] for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    plain, beyond = PLAIN.findall, BEYOND.search

    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if beyond(text):
                return [w for w, _ in cut.pre_tokenize_str(tok.normalizer.normalize_str(text))] if text else []
        return plain(text.lower())

    def split(text: str) -> list[str]:
        if at_special is None or not any(m in text for m in marks):
            return words(text)
        out: list[str] = []
        for i, part in enumerate(at_special.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split


def word_encoder(spec: str) -> Callable[[str], list[int]]:
    """word -> ids."""
    from tokenizers import pre_tokenizers

    tok = load(spec)
    special = {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]}
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    tokenize = tok.model.tokenize

    def encode(word: str) -> list[int]:
        if word in special:
            return [special[word]]
        return [t.id for t in tokenize(as_bytes(word)[0][0])]

    return encode


def _pack(a: np.ndarray) -> bytes:
    """int32 values as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _pack_small(a: np.ndarray) -> bytes:
    """Numbers that are mostly small: seven bits at a time, the first of all, then the next of those that go on, ..."""
    import zstandard

    out, x = [], a.astype(np.uint32)
    while True:
        more = x >= 128
        out.append(zstandard.ZstdCompressor(level=3).compress((x & 127 | more.astype(np.uint32) << 7).astype(np.uint8).tobytes()))
        if not more.any():
            return np.array([len(out), *map(len, out)], "<i4").tobytes() + b"".join(out)
        x = x[more] >> 7


def _unpack_small(b: bytes) -> np.ndarray:
    import zstandard

    n = int(np.frombuffer(b, "<i4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(b, "<i4", n, 4))
    x = None
    for end, size in zip(ends[::-1].tolist(), np.frombuffer(b, "<i4", n, 4)[::-1].tolist(), strict=True):
        first = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[end - size : end]), np.uint8)
        value = (first & 127).astype(np.int32)
        if x is not None:
            value[first >= 128] |= x << 7
        x = value
    return x


#: A block's own row has bucket -1; the others hold its words (lengths and UTF-8 bytes) by hash bucket.
BLOCKS = "block long, bucket int, doc_ids array<long>, n_words array<int>, codes binary, words binary"
IDS = "block long, bucket int, lens binary, ids binary"


def _joined(words: list[str]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode("utf-8", "surrogatepass"))


def _parted(body: bytes) -> list[str]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass").split("\n")


def blocks(docs: DataFrame, spec: str, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of BLOCKS.  Codes number a block's distinct words, most frequent first; the words of bucket b are
    those whose hash is b, in the order of their codes (no word has white space in it, so a line holds one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        split = splitter(spec)

        def block(ids: list, known: dict[str, int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate(parts)
            order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), np.int32)
            rank[order] = np.arange(len(known), dtype=np.int32)
            words = list(known)
            words = [words[i] for i in order.tolist()]
            hashes = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            place = np.argsort(bucket, kind="stable")
            borders = np.searchsorted(bucket[place], np.arange(buckets + 1))
            name = uuid.uuid4().int >> 65
            out = [(-1, ids, [len(p) for p in parts], _pack_small(rank[codes]), _pack(place.astype(np.int32)))]
            for b in np.flatnonzero(np.diff(borders)).tolist():
                out.append((b, None, None, None, _joined([words[i] for i in place[borders[b] : borders[b + 1]].tolist()])))
            for at in range(0, len(out), 4096):
                some = list(zip(*out[at : at + 4096], strict=True))
                yield batch(
                    block=pa.array([name] * len(some[0]), pa.int64()),
                    bucket=pa.array(some[0], pa.int32()),
                    doc_ids=pa.array(some[1], pa.list_(pa.int64())),
                    n_words=pa.array(some[2], pa.list_(pa.int32())),
                    codes=pa.array(some[3], pa.binary()),
                    words=pa.array(some[4], pa.binary()),
                )

        ids, parts, size = [], [], 0
        known: dict[str, int] = _Codes()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                found = split(text)
                ids.append(doc_id)
                parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= block_chars:
                    yield from block(ids, known, parts)
                    ids, parts, size, known = [], [], 0, _Codes()
        if ids:
            yield from block(ids, known, parts)

    return map_arrow(texts(docs), run, BLOCKS)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def encoded_words(cut: DataFrame, spec: str) -> DataFrame:
    """Bucket after bucket, each distinct word encoded once; the ids of a block's words of a bucket in one row."""
    uses = cut.where("bucket >= 0").select("block", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(spec)
        done: dict[str, np.ndarray] = {}
        now = None
        for b in batches:
            lens, ids = [], []
            for bucket, body in zip(b.column("bucket").to_pylist(), b.column("words"), strict=True):
                if bucket != now:
                    done, now = {}, bucket
                words = _parted(body.as_py())
                for w in words:
                    if w not in done:
                        done[w] = np.array(encode(w), np.int32)
                said = [done[w] for w in words]
                lens.append(_pack_small(np.fromiter(map(len, said), np.int32, len(said))))
                ids.append(_pack(np.concatenate(said)))
            yield batch(block=b.column("block"), bucket=b.column("bucket"), lens=pa.array(lens, pa.binary()), ids=pa.array(ids, pa.binary()))

    return map_arrow(uses, run, IDS)


def encode(docs: DataFrame, tokenizer: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) of every document; ``tokenizer``: the path of a tokenizer file."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = checked(f.read())
    tok = load(spec)
    pieces = [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(blocks(docs, spec, buckets, block_chars), "bpe-blocks")
    ids = encoded_words(cut, spec)
    none = F.lit(None).cast("binary")
    own = cut.where("bucket < 0").select("block", F.lit(buckets).alias("bucket"), none.alias("lens"), none.alias("ids"), "doc_ids", "n_words", "codes", F.col("words").alias("place"))
    back = ids.select("*", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("n_words"), none.alias("codes"), none.alias("place"))
    # a block's ids come in the order of its buckets, then its own row
    meets = back.unionByName(own).repartition("block").sortWithinPartitions("block", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, flat = [], []
        for b in batches:
            for i, own in enumerate(b.column("codes").is_valid().to_pylist()):
                if own:
                    yield from join(lens, flat, *(b.column(c)[i].as_py() for c in ("doc_ids", "n_words", "codes", "place")))
                    lens, flat = [], []
                else:
                    lens.append(b.column("lens")[i].as_py())
                    flat.append(b.column("ids")[i].as_py())

    def join(lens: list[bytes], flat: list[bytes], doc_ids: list, n_words: list, codes: bytes, place: bytes) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int32)
        place, codes = _unpack(place), _unpack_small(codes)
        len_all = np.concatenate([_unpack_small(x) for x in lens]).astype(np.int64) if lens else empty.astype(np.int64)
        flat_all = np.concatenate([_unpack(x) for x in flat]) if flat else empty
        size, start = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        size[place], start[place] = len_all, np.cumsum(len_all) - len_all
        text = [" ".join([pieces[i] for i in flat_all[a : a + k].tolist()]) for a, k in zip(start.tolist(), size.tolist(), strict=True)]
        out_docs, out_ids, out_text, offsets, chars, at = [], [], [], [0], 0, 0

        def rows() -> pa.RecordBatch:
            values = pa.array(np.concatenate(out_ids), pa.int32())
            return batch(
                doc_id=pa.array(out_docs, pa.int64()),
                ids=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                decoded=pa.array(out_text, pa.string()),
            )

        for doc_id, k in zip(doc_ids, n_words, strict=True):
            c = codes[at : at + k]
            at += k
            lens_ = size[c]
            total = int(lens_.sum())
            # the ids of each word lie together: its start, repeated, plus 0, 1, ... within the word
            first = np.cumsum(lens_) - lens_
            out_ids.append(flat_all[np.repeat(start[c] - first, lens_) + np.arange(total)])
            out_text.append(" ".join(map(text.__getitem__, c.tolist())))
            out_docs.append(doc_id)
            offsets.append(offsets[-1] + total)
            chars += len(out_text[-1])
            if chars >= OUT_CHARS:
                yield rows()
                out_docs, out_ids, out_text, offsets, chars = [], [], [], [0], 0
        if out_docs:
            yield rows()

    return map_arrow(meets, run, "doc_id long, ids array<int>, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
