"""Problem 9: texts that look the same but differ in their characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracemill.llm.visual_form import visual_form
from tracemill.runtime import dealt, interim_table, table


def visual_form_of(text: Column | str) -> Column:
    """The visual form of a text column; null gives null and empty gives empty.

    Width, kind of blank, invisible characters, joined letters, composed or
    combining accents and borrowed letters are made uniform; case, accents,
    superscripts, line breaks and digits are kept.
    """

    @arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        return visual_form(texts)

    return form(text)


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of rows whose texts differ but have one visual form: <id>_a < <id>_b.

    Null texts pair with nothing. Rows with equal texts don't pair with each
    other; a repeated id counts once. Extra columns are ignored. Texts travel as
    two 16-byte digests, written once. The different texts of a form are paired,
    whatever number of rows has them; the rows come in last, and every row of
    that join is a row of the result.
    """
    digest = lambda c: F.unhex(F.md5(c))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    keyed = src.select("_id", digest(F.col("_text")).alias("_t"), visual_form_of("_text").alias("_v")).select("_id", "_t", digest(F.col("_v")).alias("_f"))
    keyed = interim_table(keyed, "forms")
    several = keyed.groupBy("_f").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).where("lo != hi").select("_f")
    rows = keyed.where("_id is not null").join(several, "_f", "left_semi")
    texts = rows.select("_f", "_t").distinct()
    twins = texts.withColumnRenamed("_t", "ta").join(texts.withColumnRenamed("_t", "tb"), "_f").where("ta < tb").drop("_f")
    left, right = rows.select(F.col("_t").alias("ta"), F.col("_id").alias("a")), rows.select(F.col("_t").alias("tb"), F.col("_id").alias("b"))
    pairs = twins.join(left, "ta").join(right, "tb").where("a != b")
    return pairs.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir, "documents"))


def p9_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, how many documents change under the visual form."""
    docs = dealt(table(spark, sf_dir, "documents").select("source", "text"), sf_dir, "documents")
    formed = docs.withColumn("form", visual_form_of("text"))
    return formed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("form") != F.col("text")).alias("changed"), F.sum(F.length("text")).alias("chars_before"), F.sum(F.length("form")).alias("chars_after"))


QUERIES = {"p9_found": p9_found, "p9_changed": p9_changed}
# Fixed values for SQL, written out apart from the tables of the engine: letters borrowed from another script and what they look like, blanks,
# invisible characters as a class, and joined letters. They cover what SQL can bring together; marks beyond what its normal form composes are left.
_BORROWED = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναριϲϳАВЕЅІЈКМНОРСТУХҮԌԚԜӀаеорсухѕіјһԁԛԝүӏёЁїЇ", "ABEZHIKMNOPTYXovapicjABESIJKMHOPCTYXYGQWIaeopcyxsijhdqwyleEiI".replace("leEiI", "lëËïÏ"))
_WIDE = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
_GAPS = "               　\t"
_UNSEEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
_JOINED = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬅ": "st", "ﬆ": "st"}


def visual_form_sql(text: str) -> str:
    """The visual form of a text in DuckDB's SQL, for texts whose marks its normal form composes."""
    quote = lambda x: x.replace("'", "''")
    form = f"regexp_replace({text}, '{_UNSEEN}', '', 'g')"
    for one, several in _JOINED.items():
        form = f"replace({form}, '{one}', '{several}')"
    form = f"translate({form}, '{quote(_WIDE[0] + _BORROWED[0] + _GAPS)}', '{quote(_WIDE[1] + _BORROWED[1] + ' ' * len(_GAPS))}')"
    return f"nfc_normalize({form})"


SQL = {
    "p9_found": f"""WITH f AS MATERIALIZED (SELECT doc_id, text, md5({visual_form_sql("text")}) AS v FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.v = b.v AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_changed": f"""WITH f AS (SELECT source, text, {visual_form_sql("text")} AS v FROM documents) SELECT source, count(*) AS docs, count(*) FILTER (v <> text) AS changed, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(v)) AS BIGINT) AS chars_after FROM f GROUP BY 1""",
}
