"""The registered queries of this package: each applies one operator to its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE`` holds DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, imatch, language, neighbours, packing, periods, phrases, pii, quality, search, simhash, toxicity


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; SQL can't express BPE, so tests compare with the public library."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors; tests compare with all pairs of a small table."""
    return neighbours.groups(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; tests compare with all pairs of a small table."""
    return simhash.groups(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page; tests compare with a plain parser of the page template."""
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20; tests compare with brute force."""
    return search.top_k(_table(spark, sf_dir, "documents"), F.col("id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; tests check the packing itself."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; tests measure the held-out accuracy."""
    return language.judged(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with its entities replaced by surrogates; tests check the surrogates themselves."""
    return pii.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document; tests measure the held-out accuracy."""
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document; tests measure the held-out accuracy."""
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; tests compare with brute force over a small table."""
    rows = imatch.with_next(_table(spark, sf_dir, "documents"))
    near = lambda other: imatch.likeness(F.col("fingerprint"), F.col(other))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def _words(text: Column) -> Column:
    """The words of a text, separated by the space and the characters 9 to 13."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _made_periodic(id_: Column, words: Column) -> Column:
    """The words, where the checksum of the id ends in 0 with a period from some word on."""
    h, n = F.crc32(id_.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    of = lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
    return F.when((h % 10 == 0) & (n > 0), F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), of)[0]).otherwise(words)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words, of which some are made periodic; tests compare with a plain search for all periods."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = periods.with_runs(docs.select("doc_id", _made_periodic(F.col("doc_id"), F.col("words")).alias("words")))
    denser = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get(F.col("runs"), 0), lambda y, x: F.when(denser(x, y), x).otherwise(y))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_neighbours": op1_neighbours, "op2_simhash": op2_simhash, "op3_bpe": op3_bpe, "op4_html": op4_html, "op5_search": op5_search, "op6_packing": op6_packing, "op7_language": op7_language, "op8_pii": op8_pii, "op9_toxicity": op9_toxicity, "op10_quality": op10_quality, "op11_imatch": op11_imatch, "op12_periods": op12_periods, "op13_phrases": op13_phrases}
#: SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op13_phrases": r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, (VALUES (1), (2), (3), (4)) sizes(k)),
grams AS (SELECT lang, k AS size, list_slice(w, i, i + k - 1) AS g, count(*)::HUGEINT AS f FROM placed GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT * FROM grams WHERE size > 1),
cuts AS (SELECT lang, g, size, f, unnest(range(1, size)) AS k FROM candidates),
scored AS (SELECT c.lang, c.g, c.size, c.f AS a, c.k, x.f AS l, y.f AS r, (2000000 * c.f) // (x.f + y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k) JOIN grams y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, c.size)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
wider AS (SELECT lang, g, size, f, unnest(range(2, size)) AS m FROM candidates WHERE size > 2),
inner_ AS (SELECT lang, g, f, m, unnest(range(1, size - m + 2)) AS i FROM wider),
longer AS (SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS f FROM inner_ GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * o.f < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
}
