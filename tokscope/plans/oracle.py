"""DuckDB SQL restatements of the registered queries (the correctness oracle).

The SQL is generated from the same tokenizer specs and Unicode classes the Spark side uses,
so both sides agree on patterns; everything else (vocabulary learning, encoding, sampling,
metrics) is restated relationally here, independently of the Spark code.  RE2 and Java
regex accept the same ``\\x{..}`` classes, ``\\p{L}`` and ``(?s)``.
"""

from __future__ import annotations

from ..functions import scalars as S
from ..functions import unicode_classes as uc
from ..operators.segment import DEFAULT_TOKEN_SAMPLE, DEFAULT_UNIT_SAMPLE
from ..operators.tokenizers import CHAR_PATTERN, NativeTokenizer, default_tokenizers
from ..sources.text import LANGUAGE_CODES, UNKNOWN_SCRIPT

ROUND = 6
DOUBLE_METRICS = {"bytes_per_token", "subword_fertility", "word_split_pct", "continuation_token_pct", "continued_word_rate"}
# The whole text of a language as one string, so that the oracle never sees a document's end.
SEP_DOCS = """sdocs AS (
  SELECT lang_key, min(doc_id) AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM docs GROUP BY lang_key
)"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rnd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {ROUND})"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN coalesce({den}, 0) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


def method_sql(iso: str, script: str) -> str:
    iso_l = f"lower(coalesce({iso}, ''))"
    scr = f"coalesce({script}, '')"
    syl = " OR ".join(f"({iso_l} = {q(i)} AND {scr} = {q(s)})" for i, s in S.SYLLABLE_BASED_PAIRS)
    syl += f" OR {scr} IN ({', '.join(q(s) for s in S.SYLLABLE_BASED_SCRIPTS)})"
    ch = " OR ".join(f"({iso_l} = {q(i)} AND {scr} = {q(s)})" for i, s in S.CHARACTER_BASED_PAIRS)
    ch += f" OR {scr} IN ({', '.join(q(s) for s in S.CHARACTER_BASED_SCRIPTS)})"
    ch += f" OR contains({scr}, {q(S.CHARACTER_BASED_SCRIPT_SUBSTRING)})"
    return f"(CASE WHEN {syl} THEN 'syllable' WHEN {ch} THEN 'character' ELSE 'whitespace' END)"


def ws_units(text: str) -> str:
    return f"regexp_extract_all({text}, {q(uc.whitespace_unit_pattern())})"


def char_units(text: str) -> str:
    return f"regexp_extract_all({text}, {q(uc.character_unit_pattern())})"


def syl_units(text: str) -> str:
    w = uc.ws()
    strip = f"regexp_replace(x, {q(f'^[{w}]+|[{w}]+$')}, '', 'g')"
    return f"list_filter(list_transform(string_split({text}, {q(S.TSHEG)}), lambda x: {strip}), lambda x: x <> '')"


def syl_chars(text: str) -> str:
    return f"list_filter({char_units(text)}, lambda x: x <> {q(S.TSHEG)})"


def documents_cte(with_code: bool = False) -> str:
    codes = _values([(c, i, s, n) for c, i, s, n, _f in LANGUAGE_CODES], ["code", "iso_code", "script", "language"])
    code = ""
    if with_code:
        from .oracle_catalog import code_rows_sql

        code = f"""
  UNION ALL
  SELECT lang || '-code', lang, 'code', upper(lang[1]) || lower(lang[2:]) || ' (code)', 'starcoder', doc_id, text
  FROM ({code_rows_sql()}) WHERE text IS NOT NULL AND text <> ''"""
    return f"""docs AS (
  SELECT coalesce(c.iso_code, d.lang) || '-' || coalesce(c.script, {q(UNKNOWN_SCRIPT)}) AS lang_key,
         coalesce(c.iso_code, d.lang) AS iso_code, coalesce(c.script, {q(UNKNOWN_SCRIPT)}) AS script,
         coalesce(c.language, d.lang) AS language, 'documents' AS source, d.doc_id, d.text
  FROM documents d LEFT JOIN {codes} c ON d.lang = c.code
  WHERE d.text IS NOT NULL AND d.text <> ''{code}
)"""


def langs_cte(docs: str = "docs") -> str:
    """Per-language totals incl. the unit kind (syllable fallback) and first document."""
    m = method_sql("iso_code", "script")
    return f"""dstat AS (
  SELECT lang_key, iso_code, script, language, source, doc_id, {m} AS method, strlen(text) AS n_bytes,
         CASE WHEN {m} = 'whitespace' THEN len({ws_units('text')}) WHEN {m} = 'character' THEN len({char_units('text')}) ELSE 0 END AS n_plain,
         CASE WHEN {m} = 'syllable' THEN len({syl_units('text')}) ELSE 0 END AS n_syl,
         CASE WHEN {m} = 'syllable' THEN len({syl_chars('text')}) ELSE 0 END AS n_syl_chars
  FROM {docs}
),
lagg AS (
  SELECT lang_key, iso_code, script, language, source, any_value(method) AS segmentation_method,
         count(*) AS n_docs, min(doc_id) AS first_doc, sum(n_bytes) AS doc_bytes,
         sum(n_plain) AS n_plain, sum(n_syl) AS n_syl, sum(n_syl_chars) AS n_syl_chars
  FROM dstat GROUP BY ALL
),
langs AS (
  SELECT *, CAST(doc_bytes + n_docs - 1 AS BIGINT) AS total_bytes,
         CASE WHEN unit_kind = 'syllable' THEN n_syl WHEN unit_kind = 'syllable_chars' THEN n_syl_chars ELSE n_plain END AS total_units
  FROM (SELECT *, CASE WHEN segmentation_method <> 'syllable' THEN segmentation_method
                       WHEN n_syl < {S.MIN_SYLLABLES} THEN 'syllable_chars' ELSE 'syllable' END AS unit_kind FROM lagg)
)"""


def vocab_ctes(toks: list[NativeTokenizer]) -> str:
    parts = ["train AS (SELECT text FROM benchmark WHERE text IS NOT NULL AND text <> '')"]
    words, chars = [], []
    for t in toks:
        if t.word_slots > 0:
            words.append(
                f"""SELECT {q(t.name)} AS tokenizer, piece, [CAST(row_number() OVER (ORDER BY freq DESC, piece) - 1 + {t.word_base} AS INTEGER)] AS ids
  FROM (SELECT piece, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, {q(t.piece_pattern)})) AS piece FROM train)
        GROUP BY piece ORDER BY freq DESC, piece LIMIT {t.word_slots})"""
            )
        if t.char_slots > 0:
            chars.append(
                f"""SELECT {q(t.name)} AS tokenizer, ch, CAST(row_number() OVER (ORDER BY freq DESC, ch) - 1 + {t.char_base} AS INTEGER) AS char_id
  FROM (SELECT ch, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, {q(CHAR_PATTERN)})) AS ch FROM train)
        GROUP BY ch ORDER BY freq DESC, ch LIMIT {t.char_slots})"""
            )
    if not words:
        words.append("SELECT NULL::VARCHAR AS tokenizer, NULL::VARCHAR AS piece, NULL::INTEGER[] AS ids WHERE false")
    if not chars:
        chars.append("SELECT NULL::VARCHAR AS tokenizer, NULL::VARCHAR AS ch, NULL::INTEGER AS char_id WHERE false")
    parts.append("wvocab AS (" + "\nUNION ALL\n".join(f"({w})" for w in words) + ")")
    parts.append("cvocab AS (" + "\nUNION ALL\n".join(f"({c})" for c in chars) + ")")
    specials = _values(
        [(t.name, str(t.n_special), str(t.vocab_size), str(t.bos_id if t.bos_id is not None else -1)) for t in toks],
        ["tokenizer", "n_special_s", "vocab_size_s", "bos_id_s"],
    )
    parts.append(
        f"toks AS (SELECT tokenizer, CAST(n_special_s AS INTEGER) AS n_special, CAST(vocab_size_s AS BIGINT) AS vocab_size, "
        f"CAST(bos_id_s AS INTEGER) AS bos_id FROM {specials})"
    )
    return ",\n".join(parts)


def utf8_bytes_sql(ch: str) -> str:
    cp = f"unicode({ch})"
    return (
        f"(CASE WHEN {cp} < 128 THEN [{cp}] "
        f"WHEN {cp} < 2048 THEN [192 | ({cp} >> 6), 128 | ({cp} & 63)] "
        f"WHEN {cp} < 65536 THEN [224 | ({cp} >> 12), 128 | (({cp} >> 6) & 63), 128 | ({cp} & 63)] "
        f"ELSE [240 | ({cp} >> 18), 128 | (({cp} >> 12) & 63), 128 | (({cp} >> 6) & 63), 128 | ({cp} & 63)] END)"
    )


def encode_ctes(prefix: str, source: str, keys: list[str], text: str, toks: list[NativeTokenizer]) -> str:
    """CTEs ``{prefix}_stream(keys..., tokenizer, token_id)`` for every tokenizer (no specials)."""
    k = ", ".join(keys)
    piece_parts = [
        f"SELECT {k}, {q(t.name)} AS tokenizer, unnest(regexp_extract_all({text}, {q(t.piece_pattern)})) AS piece FROM {source}"
        for t in toks
    ]
    unk = [(t.name, t.unk_id) for t in toks if t.unk_id is not None]
    unk_case = (
        "CASE " + " ".join(f"WHEN tokenizer = {q(n)} THEN {u}" for n, u in unk) + " END" if unk else "NULL::INTEGER"
    )
    return f"""{prefix}_pieces AS ({' UNION ALL '.join(piece_parts)}),
{prefix}_wj AS (
  SELECT p.*, w.ids, {unk_case} AS unk FROM {prefix}_pieces p LEFT JOIN wvocab w ON p.tokenizer = w.tokenizer AND p.piece = w.piece
),
{prefix}_known AS (SELECT {k}, tokenizer, unnest(ids) AS token_id FROM {prefix}_wj WHERE ids IS NOT NULL),
{prefix}_unk AS (SELECT {k}, tokenizer, unk AS token_id FROM {prefix}_wj WHERE ids IS NULL AND unk IS NOT NULL),
{prefix}_uc AS (SELECT {k}, tokenizer, unnest(regexp_extract_all(piece, {q(CHAR_PATTERN)})) AS ch FROM {prefix}_wj WHERE ids IS NULL AND unk IS NULL),
{prefix}_cj AS (SELECT u.*, c.char_id FROM {prefix}_uc u LEFT JOIN cvocab c ON u.tokenizer = c.tokenizer AND u.ch = c.ch),
{prefix}_stream AS (
  SELECT {k}, tokenizer, token_id FROM {prefix}_known
  UNION ALL SELECT {k}, tokenizer, token_id FROM {prefix}_unk
  UNION ALL SELECT {k}, tokenizer, char_id AS token_id FROM {prefix}_cj WHERE char_id IS NOT NULL
  UNION ALL SELECT {k}, tokenizer, unnest({utf8_bytes_sql('ch')}) AS token_id FROM {prefix}_cj WHERE char_id IS NULL
)"""


def units_of_sql(text: str, kind: str) -> str:
    return (
        f"(CASE WHEN {kind} = 'whitespace' THEN {ws_units(text)} WHEN {kind} = 'character' THEN {char_units(text)} "
        f"WHEN {kind} = 'syllable' THEN {syl_units(text)} ELSE {syl_chars(text)} END)"
    )


def sampled_units_ctes(max_units: int | None = DEFAULT_UNIT_SAMPLE) -> str:
    cond = "upos % step = 0" + (f" AND upos // step < {max_units}" if max_units is not None else "")
    step = f"greatest(1, total_units // {max_units})" if max_units is not None else "1"
    return f"""du AS (
  SELECT d.lang_key, d.doc_id, {units_of_sql('d.text', 'l.unit_kind')} AS units FROM docs d JOIN langs l USING (lang_key)
),
duo AS (
  SELECT lang_key, doc_id, units,
         coalesce(sum(len(units)) OVER (PARTITION BY lang_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u_off
  FROM du
),
ul AS (SELECT lang_key, unnest(units) AS unit, u_off + generate_subscripts(units, 1) - 1 AS upos FROM duo),
su AS (
  SELECT ul.lang_key, ul.upos, ul.unit FROM ul JOIN (SELECT lang_key, {step} AS step FROM langs) s USING (lang_key)
  WHERE {cond}
)"""


def language_metrics_sql(
    toks: list[NativeTokenizer] | None = None,
    max_units: int | None = DEFAULT_UNIT_SAMPLE,
    final: bool = True,
    with_code: bool = False,
) -> str:
    """WITH-list ending in ``metrics``; with ``final`` a SELECT of the rounded record."""
    ctes = language_metrics_ctes(toks, max_units, with_code)
    with_list = "WITH " + ",\n".join(ctes)
    if not final:
        return with_list
    return with_list + f"""
SELECT tokenizer, lang_key, iso_code, script, language, source, segmentation_method, total_bytes, total_tokens,
       unique_tokens, {rnd('bytes_per_token')} AS bytes_per_token, total_units, {rnd('subword_fertility')} AS subword_fertility,
       {rnd('word_split_pct')} AS word_split_pct, {rnd('continuation_token_pct')} AS continuation_token_pct,
       {rnd('continuation_token_pct')} AS continued_word_rate, estimated_units_split
FROM metrics"""


def by_origin_cte() -> str:
    """``docs`` keyed by the origin of each document (its ``source`` column) over all languages."""
    return """docs AS (
  SELECT source AS lang_key, 'eng' AS iso_code, 'Latn' AS script, '' AS language, '' AS source, doc_id, text
  FROM documents WHERE text IS NOT NULL AND text <> ''
)"""


def language_metrics_by_source_sql() -> str:
    ctes = language_metrics_ctes()
    return "WITH " + ",\n".join([by_origin_cte(), *ctes[1:]]) + f"""
SELECT tokenizer, lang_key AS source, total_bytes, total_tokens, unique_tokens, {rnd('bytes_per_token')} AS bytes_per_token,
       total_units, {rnd('subword_fertility')} AS subword_fertility, {rnd('word_split_pct')} AS word_split_pct FROM metrics"""


def language_metrics_ctes(toks=None, max_units: int | None = DEFAULT_UNIT_SAMPLE, with_code: bool = False) -> list[str]:
    toks = toks or default_tokenizers()
    sep_docs = SEP_DOCS
    ctes = [
        documents_cte(with_code),
        langs_cte(),
        vocab_ctes(toks),
        sep_docs,
        encode_ctes("dt", "sdocs", ["lang_key"], "text", toks),
        """ttot AS (SELECT tokenizer, lang_key, count(*) AS text_tokens, count(DISTINCT token_id) AS distinct_ids FROM dt_stream GROUP BY ALL)""",
        sampled_units_ctes(max_units),
        encode_ctes("ut", "su", ["lang_key", "upos"], "unit", toks),
        """uk AS (SELECT tokenizer, lang_key, upos, count(*) AS k FROM ut_stream GROUP BY ALL),
splits AS (
  SELECT tokenizer, lang_key, count(*) AS n_sampled, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_split,
         sum(greatest(k - 1, 0)) AS n_cont, sum(k) AS n_unit_tokens
  FROM uk GROUP BY ALL
)""",
        f"""metrics AS (
  SELECT t.tokenizer, l.lang_key, l.iso_code, l.script, l.language, l.source, l.segmentation_method,
         l.total_bytes, CAST(t.text_tokens + k.n_special AS BIGINT) AS total_tokens,
         CAST(t.distinct_ids + k.n_special AS BIGINT) AS unique_tokens,
         {ratio('l.total_bytes', 't.text_tokens + k.n_special')} AS bytes_per_token,
         CAST(l.total_units AS BIGINT) AS total_units,
         CASE WHEN l.total_units > 0 THEN {ratio('t.text_tokens + k.n_special', 'l.total_units')} ELSE 0.0 END AS subword_fertility,
         CASE WHEN l.total_units > 0 THEN {ratio('s.n_split', 's.n_sampled')} * 100.0 ELSE 0.0 END AS word_split_pct,
         CASE WHEN l.total_units > 0 THEN {ratio('s.n_cont', 's.n_unit_tokens')} * 100.0 ELSE 0.0 END AS continuation_token_pct,
         CASE WHEN l.total_units > 0 THEN {ratio('s.n_cont', 's.n_unit_tokens')} * 100.0 ELSE 0.0 END AS continued_word_rate,
         CASE WHEN l.total_units > 0 THEN CAST(trunc({ratio('s.n_split', 's.n_sampled')} * l.total_units) AS BIGINT) ELSE 0 END AS estimated_units_split,
         k.vocab_size
  FROM ttot t JOIN toks k USING (tokenizer) JOIN langs l USING (lang_key)
  LEFT JOIN splits s ON s.tokenizer = t.tokenizer AND s.lang_key = t.lang_key
)""",
    ]
    return ctes


def snippet_sql() -> str:
    """WITH-list ending in ``snip(lang_key, byte_offset, text)``: bytes of the joined text, broken ends dropped."""
    from ..operators.snippet import MIN_SKIP_BYTES, SNIPPET_BYTES

    n, skip = SNIPPET_BYTES, MIN_SKIP_BYTES
    return "WITH " + ",\n".join([
        documents_cte(),
        SEP_DOCS,
        f"""seeds AS (
  SELECT lang_key, CAST('0x' || substr(sha1(iso_code || ':' || script), 1, 16) AS UBIGINT) AS seed
  FROM (SELECT DISTINCT lang_key, iso_code, script FROM docs)
),
spans AS (
  SELECT lang_key, text, seed, greatest(strlen(text) - {n}, 0) AS hi,
         CASE WHEN strlen(text) <= {n + skip} THEN 0 ELSE {skip} END AS lo
  FROM sdocs JOIN seeds USING (lang_key)
),
offs AS (SELECT lang_key, text, CAST(lo + CAST(seed % CAST(hi - lo + 1 AS UBIGINT) AS BIGINT) AS BIGINT) AS byte_offset FROM spans),
raw AS (SELECT lang_key, byte_offset, substr(hex(encode(text)), CAST(2 * byte_offset + 1 AS BIGINT), {2 * n}) AS h FROM offs),
snip AS (
  SELECT lang_key, byte_offset, decode(unhex(regexp_replace(regexp_replace(h, '^([89AB][0-9A-F])+', ''),
         '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){{0,2}})$', ''))) AS text
  FROM raw
)""",
    ])


def ordered_encode_ctes(prefix: str, source: str, keys: list[str], text: str, toks: list[NativeTokenizer]) -> str:
    """Like :func:`encode_ctes` but keeps ``pidx, cidx, bidx`` (1-based) for text order."""
    k = ", ".join(keys)
    piece_parts = [
        f"SELECT {k}, {q(t.name)} AS tokenizer, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pidx "
        f"FROM (SELECT {k}, regexp_extract_all({text}, {q(t.piece_pattern)}) AS ps FROM {source})"
        for t in toks
    ]
    unk = [(t.name, t.unk_id) for t in toks if t.unk_id is not None]
    unk_case = (
        "CASE " + " ".join(f"WHEN tokenizer = {q(n)} THEN {u}" for n, u in unk) + " END" if unk else "NULL::INTEGER"
    )
    return f"""{prefix}_pieces AS ({' UNION ALL '.join(piece_parts)}),
{prefix}_wj AS (
  SELECT p.*, w.ids, {unk_case} AS unk FROM {prefix}_pieces p LEFT JOIN wvocab w ON p.tokenizer = w.tokenizer AND p.piece = w.piece
),
{prefix}_known AS (SELECT {k}, tokenizer, pidx, generate_subscripts(ids, 1) AS cidx, 1 AS bidx, unnest(ids) AS token_id FROM {prefix}_wj WHERE ids IS NOT NULL),
{prefix}_unk AS (SELECT {k}, tokenizer, pidx, 1 AS cidx, 1 AS bidx, unk AS token_id FROM {prefix}_wj WHERE ids IS NULL AND unk IS NOT NULL),
{prefix}_uc AS (
  SELECT {k}, tokenizer, pidx, unnest(chs) AS ch, generate_subscripts(chs, 1) AS cidx
  FROM (SELECT *, regexp_extract_all(piece, {q(CHAR_PATTERN)}) AS chs FROM {prefix}_wj WHERE ids IS NULL AND unk IS NULL)
),
{prefix}_cj AS (SELECT u.*, c.char_id FROM {prefix}_uc u LEFT JOIN cvocab c ON u.tokenizer = c.tokenizer AND u.ch = c.ch),
{prefix}_ub AS (SELECT *, {utf8_bytes_sql('ch')} AS bs FROM {prefix}_cj WHERE char_id IS NULL),
{prefix}_ostream AS (
  SELECT {k}, tokenizer, pidx, cidx, bidx, token_id FROM {prefix}_known
  UNION ALL SELECT {k}, tokenizer, pidx, cidx, bidx, token_id FROM {prefix}_unk
  UNION ALL SELECT {k}, tokenizer, pidx, cidx, 1 AS bidx, char_id AS token_id FROM {prefix}_cj WHERE char_id IS NOT NULL
  UNION ALL SELECT {k}, tokenizer, pidx, cidx, generate_subscripts(bs, 1) AS bidx, unnest(bs) AS token_id FROM {prefix}_ub
)"""


def decoded_vocab_ctes(toks: list[NativeTokenizer]) -> str:
    """``dvocab(tokenizer, token_id, token_text)`` for ids 0..V-1 (NULL = undecodable, BOS = '')."""
    return """dvocab AS (
  SELECT k.tokenizer, CAST(r.id AS INTEGER) AS token_id,
         CASE WHEN r.id = k.bos_id THEN ''
              ELSE coalesce(w.piece, c.ch, CASE WHEN r.id < 128 THEN chr(CAST(r.id AS INTEGER)) END) END AS token_text
  FROM toks k CROSS JOIN LATERAL (SELECT range AS id FROM range(k.vocab_size)) r
  LEFT JOIN (SELECT tokenizer, piece, ids[1] AS wid FROM wvocab WHERE len(ids) = 1) w ON w.tokenizer = k.tokenizer AND w.wid = r.id
  LEFT JOIN cvocab c ON c.tokenizer = k.tokenizer AND c.char_id = r.id
)"""


def scripts_sql(text: str) -> str:
    parts = ", ".join(
        f"CASE WHEN regexp_matches({text}, {q(uc.script_class(label))}) THEN {q(label)} END" for label in uc.SCRIPT_LABELS
    )
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def annotated_vocab_cte() -> str:
    return f"""avocab AS (
  SELECT tokenizer, token_id, token_text,
         coalesce(regexp_matches(token_text, {q(uc.starts_with_ws_pattern())}), false) AS starts_with_space,
         coalesce(regexp_matches(token_text, {q(uc.inner_ws_pattern())}), false) AS has_whitespace_in_middle,
         CASE WHEN token_text IS NULL THEN []::VARCHAR[] ELSE {scripts_sql('token_text')} END AS scripts
  FROM dvocab
)"""


def with_docs_langs(with_code: bool = False) -> str:
    return "WITH " + documents_cte(with_code) + ",\n" + langs_cte()


def _base(toks, extra: list[str], with_code: bool = False) -> str:
    return with_docs_langs(with_code) + ",\n" + vocab_ctes(toks) + ",\n" + ",\n".join(extra)


def encode_lookup_sql(toks) -> str:
    dp = "dp AS (SELECT tokenizer, piece, count(*) AS occurrences FROM dt_pieces GROUP BY ALL)"
    return _base(toks, [encode_ctes("dt", "docs", ["lang_key"], "text", toks), dp, ordered_encode_ctes("pe", "(SELECT DISTINCT piece AS p FROM dp)", ["p"], "p", toks)]) + """
SELECT d.tokenizer, d.piece, d.occurrences, CAST(count(*) AS BIGINT) AS n_ids,
       string_agg(CAST(o.token_id AS VARCHAR), ' ' ORDER BY o.cidx, o.bidx) AS ids
FROM dp d JOIN pe_ostream o ON o.p = d.piece AND o.tokenizer = d.tokenizer
GROUP BY d.tokenizer, d.piece, d.occurrences"""


def longest_match_sql(slots: int, max_len: int) -> str:
    """Greedy longest match by a recursive walk over the distinct chunks."""
    from ..operators.encode import covering_pattern

    chunks = f"unnest(regexp_extract_all(text, {q(covering_pattern([]))}))"
    return f"""WITH RECURSIVE tc AS (SELECT chunk, count(*) AS n FROM (SELECT {chunks} AS chunk FROM benchmark WHERE text IS NOT NULL AND text <> '') GROUP BY chunk),
subs AS (SELECT k, n, unnest(list_transform(range(1, length(chunk) - k + 2), lambda i: substr(chunk, i, k))) AS token FROM tc, (SELECT unnest(range(2, {max_len + 1})) AS k)),
saved AS (SELECT token, sum(n) * (any_value(k) - 1) AS saved FROM subs GROUP BY token ORDER BY saved DESC, token LIMIT {slots}),
tokens AS (SELECT token, CAST(row_number() OVER (ORDER BY saved DESC, token) + 255 AS INTEGER) AS id FROM saved),
dp AS (SELECT piece, count(*) AS occurrences FROM (SELECT {chunks} AS piece FROM documents WHERE text IS NOT NULL AND text <> '') GROUP BY piece),
spots AS (SELECT piece, unnest(range(1, length(piece) + 1)) AS pos FROM dp),
best AS (
  SELECT s.piece, s.pos, max(length(t.token)) AS len, max_by(t.id, length(t.token)) AS id
  FROM (SELECT piece, pos, unnest(range(2, {max_len + 1})) AS k FROM spots) s JOIN tokens t ON t.token = substr(s.piece, s.pos, s.k) AND length(t.token) = s.k GROUP BY ALL
),
each AS (SELECT s.piece, s.pos, coalesce(b.len, 1) AS len, b.id, substr(s.piece, s.pos, 1) AS ch FROM spots s LEFT JOIN best b USING (piece, pos)),
walk(piece, pos) AS (
  SELECT piece, 1::BIGINT FROM dp
  UNION ALL
  SELECT w.piece, w.pos + e.len FROM walk w JOIN each e ON e.piece = w.piece AND e.pos = w.pos
),
taken AS (SELECT e.piece, e.pos, CASE WHEN e.id IS NOT NULL THEN [e.id] ELSE {utf8_bytes_sql('e.ch')} END AS ids FROM walk w JOIN each e ON e.piece = w.piece AND e.pos = w.pos)
SELECT d.piece, d.occurrences, CAST(len(a.ids) AS BIGINT) AS n_ids, array_to_string(a.ids, ' ') AS ids
FROM dp d JOIN (SELECT piece, flatten(list(ids ORDER BY pos)) AS ids FROM taken GROUP BY piece) a USING (piece)"""


def _doc_counts(toks) -> list[str]:
    return [SEP_DOCS, encode_ctes("dt", "sdocs", ["lang_key"], "text", toks),
            "tc AS (SELECT tokenizer, lang_key, token_id, count(*) AS n FROM dt_stream GROUP BY ALL)"]


def decode_tokens_sql(toks) -> str:
    return _base(toks, _doc_counts(toks) + [decoded_vocab_ctes(toks)]) + """
SELECT c.tokenizer, c.lang_key, c.token_id, d.token_text, CAST(c.n AS BIGINT) AS n, d.token_text IS NOT NULL AS decodable
FROM tc c LEFT JOIN dvocab d ON d.tokenizer = c.tokenizer AND d.token_id = c.token_id"""


def token_analysis_sql(toks) -> str:
    return _base(toks, _doc_counts(toks) + [decoded_vocab_ctes(toks), annotated_vocab_cte()]) + """
SELECT c.tokenizer, c.lang_key, c.token_id, a.token_text, a.starts_with_space, a.has_whitespace_in_middle,
       array_to_string(a.scripts, ',') AS scripts, len(a.scripts) > 1 AS script_overlap, CAST(c.n AS BIGINT) AS n
FROM tc c JOIN avocab a ON a.tokenizer = c.tokenizer AND a.token_id = c.token_id
WHERE a.token_text IS NOT NULL AND length(a.token_text) > 0"""


VOCAB_ANALYSIS = """side AS (
  SELECT d.tokenizer, d.token_id, d.token_text, k.vocab_size,
         (length(d.token_text) > 0 AND NOT starts_with(d.token_text, ' ')) AS no_space
  FROM dvocab d JOIN toks k USING (tokenizer)
  WHERE d.token_id % greatest(1, k.vocab_size // greatest(least(k.vocab_size, 10000), 1)) = 0 AND d.token_text IS NOT NULL
),
ex AS (
  SELECT tokenizer, no_space, string_agg(token_text, '|' ORDER BY token_id) AS examples
  FROM (SELECT *, row_number() OVER (PARTITION BY tokenizer, no_space ORDER BY token_id) AS rn FROM side) WHERE rn <= 10
  GROUP BY ALL
),
vagg AS (SELECT tokenizer, vocab_size, count(*) AS analyzed, sum(CAST(no_space AS INTEGER)) AS nns FROM side GROUP BY ALL),
va AS (
  SELECT a.tokenizer, a.vocab_size,
         CASE WHEN a.analyzed > 0 THEN CAST(trunc(CAST(a.nns AS DOUBLE) / a.analyzed * a.vocab_size) AS BIGINT) ELSE 0 END AS tokens_without_leading_space_count,
         CASE WHEN a.analyzed > 0 THEN CAST(a.nns AS DOUBLE) / a.analyzed * 100.0 ELSE 0.0 END AS tokens_without_leading_space_pct,
         CAST(a.analyzed AS BIGINT) AS analyzed_sample_size,
         coalesce(n.examples, '') AS sample_non_space_tokens, coalesce(s.examples, '') AS sample_space_tokens
  FROM vagg a LEFT JOIN ex n ON n.tokenizer = a.tokenizer AND n.no_space
  LEFT JOIN ex s ON s.tokenizer = a.tokenizer AND NOT s.no_space
)"""


def vocab_analysis_sql(toks) -> str:
    return _base(toks, [decoded_vocab_ctes(toks), VOCAB_ANALYSIS]) + f"""
SELECT tokenizer, vocab_size, tokens_without_leading_space_count, {rnd('tokens_without_leading_space_pct')} AS tokens_without_leading_space_pct,
       analyzed_sample_size, sample_non_space_tokens, sample_space_tokens FROM va"""


def vocab_flags_sql(toks, kind: str) -> str:
    sel = (
        "tokenizer, token_id, token_text, starts_with_space, has_whitespace_in_middle"
        if kind == "ws"
        else "tokenizer, token_id, array_to_string(scripts, ',') AS scripts, len(scripts) > 1 AS script_overlap"
    )
    return "WITH " + vocab_ctes(toks) + ",\n" + decoded_vocab_ctes(toks) + ",\n" + annotated_vocab_cte() + f"\nSELECT {sel} FROM avocab WHERE token_text IS NOT NULL"


def sampled_tokens_sql(toks, max_tokens: int = DEFAULT_TOKEN_SAMPLE, with_code: bool = False) -> str:
    return _base(toks, [SEP_DOCS] + sampled_tokens_ctes(toks, max_tokens), with_code)


def sampled_tokens_ctes(toks, max_tokens: int = DEFAULT_TOKEN_SAMPLE) -> list[str]:
    """``stok`` (needs ``sdocs`` and ``toks``)."""
    return [ordered_encode_ctes("ot", "sdocs", ["lang_key", "doc_id"], "text", toks), f"""opos AS (
  SELECT o.tokenizer, o.lang_key, o.token_id, k.n_special, k.bos_id,
         k.n_special + row_number() OVER (PARTITION BY o.tokenizer, o.lang_key ORDER BY o.doc_id, o.pidx, o.cidx, o.bidx) - 1 AS tpos,
         count(*) OVER (PARTITION BY o.tokenizer, o.lang_key) + k.n_special AS total
  FROM ot_ostream o JOIN toks k USING (tokenizer)
),
stok AS (
  SELECT tokenizer, lang_key, CAST(tpos AS BIGINT) AS tpos, token_id FROM opos
  WHERE tpos % greatest(1, total // {max_tokens}) = 0 AND tpos // greatest(1, total // {max_tokens}) < {max_tokens}
  UNION ALL
  SELECT DISTINCT tokenizer, lang_key, CAST(0 AS BIGINT) AS tpos, bos_id AS token_id FROM opos WHERE n_special > 0
)"""]


def _annotated_sample(toks) -> str:
    return sampled_tokens_sql(toks) + ",\n" + decoded_vocab_ctes(toks) + ",\n" + annotated_vocab_cte() + ",\n" + ANNOTATED_SAMPLE


ANNOTATED_SAMPLE = """
ann AS (SELECT s.tokenizer, a.* EXCLUDE (tokenizer, token_id), len(a.scripts) > 1 AS script_overlap
        FROM stok s JOIN avocab a ON a.tokenizer = s.tokenizer AND a.token_id = s.token_id WHERE a.token_text IS NOT NULL),
tot AS (SELECT tokenizer, count(*) AS total, sum(CAST(starts_with_space AS INTEGER)) AS sp,
               sum(CAST(has_whitespace_in_middle AS INTEGER)) AS inn, sum(CAST(script_overlap AS INTEGER)) AS ov FROM ann GROUP BY ALL),
scr AS (SELECT tokenizer, script, count(*) AS n FROM (SELECT tokenizer, unnest(scripts) AS script FROM ann) GROUP BY ALL)"""


def global_metrics_sql(toks) -> str:
    pct = lambda c: rnd(f"CAST({c} AS DOUBLE) / total * 100.0")
    return _annotated_sample(toks) + f"""
SELECT tokenizer, 'total_tokens_analyzed' AS metric, {rnd('total')} AS value FROM tot WHERE total > 0
UNION ALL SELECT tokenizer, 'tokens_starting_with_space_pct', {pct('sp')} FROM tot WHERE total > 0
UNION ALL SELECT tokenizer, 'tokens_with_whitespace_in_middle_pct', {pct('inn')} FROM tot WHERE total > 0
UNION ALL SELECT tokenizer, 'tokens_with_script_overlap_pct', {pct('ov')} FROM tot WHERE total > 0
UNION ALL SELECT s.tokenizer, 'tokens_with_' || lower(s.script) || '_unicode_pct', {rnd('CAST(s.n AS DOUBLE) / t.total * 100.0')}
FROM scr s JOIN tot t USING (tokenizer) WHERE s.n > 0"""


def script_coverage_sql(toks) -> str:
    return _annotated_sample(toks) + f"""
SELECT s.tokenizer, s.script, CAST(s.n AS BIGINT) AS n_tokens, {rnd('CAST(s.n AS DOUBLE) / t.total * 100.0')} AS pct
FROM scr s JOIN tot t USING (tokenizer)"""


def sample_preview_sql(toks: list[NativeTokenizer]) -> str:
    """D5/F15/F16 on the snippets: ids with the BOS id, non-empty decodes, previews of twenty, wrapped by eight."""
    return snippet_sql() + ",\n" + vocab_ctes(toks) + ",\n" + ordered_encode_ctes("sn", "snip", ["lang_key"], "text", toks) + ",\n" + decoded_vocab_ctes(toks) + """,
per AS (
  SELECT s.tokenizer, s.lang_key, count(*) AS n_ids,
         list(d.token_text ORDER BY s.pidx, s.cidx, s.bidx) FILTER (d.token_text IS NOT NULL AND d.token_text <> '') AS ts
  FROM sn_ostream s LEFT JOIN dvocab d ON d.tokenizer = s.tokenizer AND d.token_id = s.token_id GROUP BY ALL
),
prev AS (SELECT *, coalesce(array_to_string(ts[1:20], '|'), '') AS p FROM per)
SELECT t.tokenizer, s.lang_key, s.byte_offset, CAST(strlen(s.text) AS BIGINT) AS text_bytes, md5(s.text) AS text_md5,
       CAST(p.n_ids + CASE WHEN t.bos_id >= 0 THEN 1 ELSE 0 END AS INTEGER) AS n_token_ids,
       CAST(coalesce(len(p.ts), 0) AS INTEGER) AS sample_token_count, p.p AS sample_tokens_preview,
       CASE WHEN p.p = '' THEN '' ELSE array_to_string(list_transform(range(1, CAST(len(string_split(p.p, '|')) AS BIGINT) + 1, 8),
            lambda i: array_to_string(string_split(p.p, '|')[i:i + 7], '|')), '<br>') END AS preview_wrapped
FROM snip s JOIN prev p USING (lang_key) JOIN toks t USING (tokenizer)"""
