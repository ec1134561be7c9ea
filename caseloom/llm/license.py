"""Licence scan by canonical digests.

The canonical form of a line is its words in lower case: signs and white space
become single spaces and equivalent spellings one form. A copyright line ("Copyright
...", "(c) 2020 ...", "All rights reserved") is dropped. The canonical form of a
text joins those of its lines, so line breaks do not count. Its digest is
hash-joined with the digests of known licence texts, short and long; each single
line's digest with those of known notices. Texts and lines are brought to that form
at any length. The known table is fixed, so it is broadcast.

Result, one row per input row: doc_id, license (null if the text as a whole is no
known licence), notices (distinct licences named by its lines, sorted, joined by a
comma; empty if none), canonical_sha256. Null and empty texts match nothing.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.license_texts import EQUIVALENT, LONG_DIGESTS, NOTICES, TEXTS
from caseloom.llm.tables import text_of

SIGNS = r"[^\p{L}\p{N}]+"
COPYRIGHT = r"^(copyright( .*)?|c [0-9]{4}.*|all rights reserved)$"
#: The SQL leaves spellings as they are in texts that are longer in canonical form; the operator does not.
LONGEST = 2000
SPELLINGS = "|".join(sorted(EQUIVALENT))


def spelled(words: Column) -> Column:
    """One form for equivalent spellings."""
    for old, new in EQUIVALENT.items():
        words = F.regexp_replace(words, rf"\b{old}\b", new)
    return words


def canonical(text: Column) -> Column:
    lines = F.split(F.lower(text), "\n")
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SIGNS, " ")))
    return F.array_join(F.filter(plain, lambda x: (x != "") & ~x.rlike(COPYRIGHT)), " ")


def digest(words: Column) -> Column:
    near = F.when(words.rlike(rf"\b({SPELLINGS})\b"), spelled(words)).otherwise(words)
    return F.sha2(near, 256)


def known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Digests of licence texts and of notices, by the same expressions."""
    texts = spark.createDataFrame(list(TEXTS.items()), "license string, text string")
    notices = spark.createDataFrame([(k, x) for k, v in NOTICES.items() for x in v], "license string, text string")
    both = [t.select("license", digest(canonical(F.col("text"))).alias("sha")) for t in (texts, notices)]
    long = spark.createDataFrame(list(LONG_DIGESTS.items()), "sha string, license string").select("license", "sha")
    return both[0].unionByName(long), both[1]


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    texts, notices = known(docs.sparkSession)
    found = {r["sha"]: r["license"] for r in notices.collect()}
    # a line's words, as long as a notice at most with room for longer spellings: what is longer equals none
    longest = 2 * max(len(x) for v in NOTICES.values() for x in v)
    lines = F.transform(F.split(F.lower(text_of(docs, text)), "\n"), lambda x: F.trim(F.regexp_replace(x, SIGNS, " ")))
    shas = F.transform(F.filter(lines, lambda x: (F.char_length(x) <= longest) & (x != "")), digest)
    table = F.create_map(*[F.lit(v) for pair in found.items() for v in pair])
    named = F.filter(F.transform(shas, lambda s: F.element_at(table, s)), lambda x: x.isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(canonical(text_of(docs, text))).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notices"))
    joined = rows.join(F.broadcast(texts), rows["canonical_sha256"] == texts["sha"], "left")
    return joined.select("doc_id", "license", "notices", "canonical_sha256")


def oracle_sql() -> str:
    """The same in DuckDB's SQL; the known digests are computed there too."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def spelled_sql(x: str) -> str:
        for old, new in EQUIVALENT.items():
            x = f"regexp_replace({x}, '\\b{old}\\b', '{new}', 'g')"
        return x

    line = "trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    canon = f"array_to_string(list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: {line}), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}')), ' ')"
    texts = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEXTS.items())
    notices = ", ".join(f"({quote(k)}, {quote(x)})" for k, v in NOTICES.items() for x in v)
    return f"""
WITH t(license, text) AS (VALUES {texts}), n(license, text) AS (VALUES {notices}),
kt AS (SELECT license, sha256({spelled_sql("w")}) AS sha FROM (SELECT license, {canon} AS w FROM t)),
kn AS (SELECT license, sha256({spelled_sql("w")}) AS sha FROM (SELECT license, {canon} AS w FROM n)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, sha256(CASE WHEN length(w) <= {LONGEST} THEN {spelled_sql("w")} ELSE w END) AS canonical_sha256 FROM (SELECT doc_id, {canon} AS w FROM d)),
l AS (SELECT doc_id, sha256({spelled_sql("w")}) AS sha FROM (
  SELECT doc_id, {line} AS w FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS x FROM d) WHERE length(x) < 200)),
m AS (SELECT l.doc_id, string_agg(DISTINCT kn.license, ',' ORDER BY kn.license) AS notices FROM l JOIN kn ON l.sha = kn.sha GROUP BY l.doc_id)
SELECT c.doc_id, kt.license, coalesce(m.notices, '') AS notices, c.canonical_sha256
FROM c LEFT JOIN kt ON c.canonical_sha256 = kt.sha LEFT JOIN m ON c.doc_id = m.doc_id
"""
