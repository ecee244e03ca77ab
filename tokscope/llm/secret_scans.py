"""Secret scans by corpus-wide ownership frequency (operator 3), with DataFrame functions only.

Candidates of a text are the spans of four kinds: ``assign``, ``access``, ``hex`` (the base patterns of the
contract) and ``known`` (token formats of well-known services, and private key blocks).  A candidate's value
is hashed, and the hashes are counted over the whole corpus: by distinct owners (``source``) and distinct
repositories (``source`` with ``lang``; reported with the verdicts).  A value that EXAMPLE_OWNERS owners or more share is
a widely copied example; a value of fewer owners with MIN_DISTINCT different characters or more looks like a live credential of
its owner; the rest is ``weak``.  Base spans are always reported; ``known`` spans only where they look live.

Span positions come from the pieces between the matches (``split``) and the matches themselves: a span starts
at the summed lengths of all pieces and matches before it.  Lengths count code points.  Running sums and cuts go in
stretches (FOLD, STRETCH), so that the work on a text grows with its length, however many matches it holds.

The candidates (without texts) are written once to the shared checkpoint folder; ownership is a two-step
count (per hash and owner, then per hash), so a value that a third of all rows carry shrinks before it moves.

Defined results: null or empty text has no spans (the digest of the empty string); a null ``source`` or
``lang`` counts as one owner or language of its own; repeated rows give repeated rows and count once for
ownership; overlapping spans of different kinds are all reported, by start, then kind; an empty table gives no rows; a
very long text is one row, searched whole; extra columns are ignored by ``scan`` and kept by ``masked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

EXAMPLE_OWNERS = 3
MIN_DISTINCT = 8
SALTS = 16
KINDS = ("assign", "access", "hex", "known")

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Any valid assignment has this in it; texts without it are not searched further.
ASSIGN_LONG = ASSIGN[:-2] + "{12,})"
#: A shorter run has no longer match within it, so the least length may stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KNOWN = (
    "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    "|eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"
    "|-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\t\\r\\n]{16,}"
)


#: Steps of a fold over an array, and code points of a stretch of text: folds and substrings never go over more.
FOLD = 256
STRETCH = 4096


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once, also where the body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op) -> Column:
    """For each number of an array, ``op`` over those before it (0 before the first).

    In stretches of FOLD: a fold that appends copies what it has, so it must stay short.
    """

    def fold(xs: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    zero = F.lit(0)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s: F.slice(values, s, FOLD))
    total = lambda xs: F.aggregate(xs, zero, op)
    return _let(parts, lambda ps: _let(fold(F.transform(ps, total), zero), lambda at: F.flatten(F.transform(ps, lambda xs, i: fold(xs, F.get(at, i))))))


def _spans(text: Column, pattern: str, kind: int, group: int, least: int, test: str) -> Column:
    """array<struct<kind, start, end, value>> of the leftmost matches, those with a long enough value."""
    regex = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else hits
    step = F.arrays_zip(
        F.transform(hits, lambda h: F.length(h)).alias("n"),
        F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g)).alias("gap"),
        values.alias("value"),
    )

    def placed(steps: Column) -> Column:
        before = _running(F.transform(steps, lambda s: s["gap"] + s["n"]), lambda a, b: a + b)
        each = F.zip_with(
            steps,
            before,
            lambda s, at: F.struct(
                F.lit(kind).alias("kind"), (at + s["gap"]).alias("start"), (at + s["gap"] + s["n"]).alias("end"), s["value"].alias("value")
            ),
        )
        return F.filter(each, lambda s: F.length(s["value"]) >= least)

    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)")
    return F.when(text.rlike(test), _let(step, placed)).otherwise(none)


def _cut(stretches: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text given in stretches of STRETCH."""
    size = F.lit(STRETCH)
    i, j = F.floor(start / size).cast("int"), F.floor((end - 1) / size).cast("int")
    at = lambda k: F.get(stretches, k)
    long = F.concat(
        F.substring(at(i), start % size + 1, size),
        F.array_join(F.slice(stretches, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.substring(at(j), F.lit(1), (end - 1) % size + 1),
    )
    return F.when(end <= start, F.lit("")).when(i == j, F.substring(at(i), start % size + 1, end - start)).otherwise(long)


def hidden(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with the mask in place of each span; spans by start, one that begins within another has no mask of its own."""

    def built(found: Column) -> Column:
        upto = _running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        kept = F.filter(F.zip_with(found, upto, lambda s, at: F.struct(at.alias("from"), s["start"].alias("to"))), lambda x: x["to"] >= x["from"])
        last = F.struct(F.array_max(F.transform(found, lambda s: s["end"])).alias("from"), F.length(text).alias("to"))
        pieces = _let(
            F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)),
            lambda st: F.transform(F.concat(kept, F.array(last)), lambda x: _cut(st, x["from"], x["to"])),
        )
        return F.array_join(pieces, mask)

    return F.when(F.size(spans) > 0, _let(spans, built)).otherwise(text)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, owner, repo, found: all candidates of each row by start, then kind.

    (doc_id, text_key) names a row's content; rows that agree in both have equal spans.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.col("source").alias("owner"),
        F.struct(F.col("source").alias("source"), F.col("lang").alias("lang")).alias("repo"),
    )
    t = F.col("text")
    parts = [
        _spans(t, ASSIGN, 0, 2, 12, ASSIGN_LONG),
        _spans(t, ACCESS, 1, 0, 18, ACCESS),
        _spans(t, HEX, 2, 0, 16, HEX),
        _spans(t, KNOWN, 3, 0, 0, KNOWN),
    ]
    in_order = F.array_sort(
        F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    )
    hashed = F.transform(
        in_order,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"),
            F.size(F.array_distinct(F.regexp_extract_all(s["value"], F.lit("[\\s\\S]"), F.lit(0)))).alias("n_distinct"),
        ),
    )
    return d.select("doc_id", F.xxhash64("text").alias("text_key"), "owner", "repo", hashed.alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over the whole corpus."""
    return (
        found.select("owner", "repo", F.explode("found.hash").alias("hash"))
        .groupBy("hash", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("n_repos"))
        .groupBy("hash")
        .agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"))
    )


def judged(found: DataFrame) -> DataFrame:
    """doc_id, text_key, spans: each candidate with its verdict (example, live or weak), one row per content."""
    each = (
        found.where(F.size("found") > 0)
        .dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", F.explode("found").alias("s"))
        .select("doc_id", "text_key", "s.*")
    )
    verdict = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("n_distinct") >= MIN_DISTINCT, "live").otherwise("weak")
    )
    # a value that very many rows carry: its rows are spread over SALTS tasks, its one ownership row is repeated for each
    owned = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(SALTS)).cast("int"))
    return (
        each.join(owned, ["hash", "salt"])
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", verdict.alias("verdict")))).alias("spans"))
    )


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, all reported spans, and the verdicts' counts."""
    found = written(candidates(docs), "secret-candidates")
    verdicts = judged(found).withColumnRenamed("spans", "judged")
    same = F.col("f.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("f.text_key") == F.col("v.text_key"))
    joined = found.alias("f").join(verdicts.alias("v"), same, "left").select(
        F.col("f.doc_id").alias("doc_id"), F.coalesce("judged", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,verdict:string>>)")).alias("s")
    )
    count = lambda test: F.size(F.filter("s", test)).cast("long")
    base = F.filter("s", lambda s: s["kind"] < 3)
    return joined.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.filter("s", lambda s: (s["kind"] < 3) | (s["verdict"] == "live"))).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mask``; ``n_chars``, where there is one, follows the text.

    Only rows that hold a candidate are joined; the others pass through their scan.
    """
    text = F.coalesce("text", F.lit(""))
    suspect = text.rlike(ASSIGN_LONG) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(KNOWN)
    names = docs.columns
    spans = judged(written(candidates(docs), "secret-candidates"))
    live = spans.select("doc_id", "text_key", F.filter("spans", lambda s: s["verdict"] == "live").alias("live")).where(F.size("live") > 0)
    hit = docs.where(suspect)
    key = (F.col("d.doc_id").cast("long").eqNullSafe(F.col("v.doc_id"))) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("v.text_key"))
    both = hit.alias("d").join(live.alias("v"), key, "left")
    old = F.col("d.text")
    built = hidden(old, F.col("v.live"), mask)
    new = F.when(F.col("v.live").isNull(), old).otherwise(built)
    put = {"text": new, "n_chars": F.when(F.col("v.live").isNull(), F.col("d.n_chars")).otherwise(F.length(new).cast("long")) if "n_chars" in names else None}
    changed = both.select(*[put[c].alias(c) if put.get(c) is not None else F.col(f"d.`{c}`") for c in names])
    return docs.where(~suspect).unionByName(changed)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_spans(pattern: str, kind: int, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: {{
        'start': coalesce(list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i - 1], lambda x: length(x))), 0),
        'kind': {kind},
        'n': length(regexp_extract_all(t, '{p}', 0)[i]),
        'v': regexp_extract_all(t, '{p}', {group})[i]}}), lambda s: length(s.v) >= {least})"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
c AS (SELECT r, source, lang, unnest(list_concat(list_concat({_sql_spans(ASSIGN, 0, 2, 12)}, {_sql_spans(ACCESS, 1, 0, 18)}),
    list_concat({_sql_spans(HEX, 2, 0, 16)}, {_sql_spans(KNOWN, 3, 0, 0)}))) AS s FROM d),
e AS (SELECT r, source, lang, s.start AS a, s.start + s.n AS b, s.kind AS k, s.v AS v FROM c),
o AS (SELECT v, count(*) AS owners FROM (SELECT DISTINCT v, source FROM e) GROUP BY v),
j AS (SELECT e.*, ['assign', 'access', 'hex', 'known'][e.k + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS said,
    CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT} THEN 'live' ELSE 'weak' END AS verdict
    FROM e JOIN o USING (v)),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    coalesce(string_agg(said, ',' ORDER BY a, k) FILTER (k < 3), '') AS base,
    coalesce(string_agg(said, ',' ORDER BY a, k) FILTER (k < 3 OR verdict = 'live'), '') AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""
