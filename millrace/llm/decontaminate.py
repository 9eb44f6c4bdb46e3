"""Benchmark decontamination: which long documents hold a short test item.  DataFrame functions only.

A text's set is its distinct five-word shingles (lower case; with fewer words, the whole sequence as one).  A document
holds an item when at least 75 in 100 of the item's shingles are in the document's set.

Items are partitioned by the size of their sets.  A partition's items are sketched by the smallest `m` of the min-wise hashes of
their shingles, with m one more than the shingles that an item of the partition's largest size may lack, so every document
that holds an item holds one of its sketch: MinHash containment without false negatives.  Documents are matched
with the sketches, and the pairs found are verified by counting the item's shingles in the document.

clean() also looks for items with a null item_id, each text by itself; contained() has no rows of null ids, and clean()
keeps documents with a null doc_id.  Null and empty texts hold nothing and are held by nothing; repeated item ids with equal texts are one item, with different
texts one item with the union of their shingles; repeated doc_ids are one document with the union of theirs;
an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, documents, drop, listed, stored

#: Rows up to which the items' sketches, and with 24 bytes a row their size, are broadcast.
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: str, n: int) -> Column:
    """Hashes of the n-word shingles of an array column of word hashes."""
    return F.expr(
        f"CASE WHEN size({words}) >= {n} THEN array_distinct(transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(n))}))) "
        f"WHEN size({words}) > 0 THEN array(xxhash64(concat_ws(' ', transform({words}, w -> cast(w AS string))))) ELSE array() END"
    )


def shingles(df: DataFrame, key: str, n: int) -> DataFrame:
    """key, shingle: the distinct shingles of each row's text."""
    hashed = df.filter(F.col(key).isNotNull()).select(key, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return hashed.select(key, F.explode(shingle_hashes("w", n)).alias("shingle"))


def contained(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 75, of_result: Tables | None = None) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, n_shingles (the item's), n_found.

    The result reads stored tables, which of_result holds, to be dropped by whoever has done with it.
    """
    of_result = of_result or Tables()
    whole = of_result.stored(shingles(items, "item_id", n).distinct())
    sizes = whole.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    # sizes from 2**p on up to 2**(p+1) are one partition; an item may lack (100 - percent) in 100 of its shingles
    ranked = (
        whole.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("shingle", F.lit(17)).alias("h"), "shingle"))).alias("s"))
        .withColumn("largest", F.expr("cast(power(2, floor(log2(size(s))) + 1) - 1 AS long)"))
        .withColumn("m", F.expr(f"least(size(s), largest * {100 - percent} div 100 + 1)"))
        .select("item_id", F.explode(F.expr("slice(s, 1, cast(m AS int))")).alias("s"))
        .select("item_id", F.col("s.shingle").alias("shingle"))
    )
    sketch = stored(ranked)
    near = F.broadcast(sketch) if sketch.count() <= BROADCAST_ROWS else sketch
    pairs = of_result.stored(shingles(docs, "doc_id", n).join(near, "shingle").select("doc_id", "item_id").distinct())
    drop(sketch)
    found = shingles(docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", n)
    table = whole.join(sizes, "item_id")
    table = F.broadcast(table) if whole.count() <= BROADCAST_ROWS else table
    counted = found.join(table, "shingle").groupBy("doc_id", "item_id", "n_shingles").agg(F.count_distinct("shingle").alias("n_found"))
    return counted.join(pairs, ["doc_id", "item_id"], "left_semi").filter(F.col("n_found") * 100 >= F.col("n_shingles") * percent)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item, items with a null id included."""
    keyed = items.select(F.xxhash64("item_id", F.expr("if(item_id is null, text, null)")).alias("item_id"), "text")
    tables = Tables()
    gone = stored(contained(docs, keyed, of_result=tables).select("doc_id").distinct())
    tables.drop()
    return docs.join(listed(gone), "doc_id", "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained(documents(spark, sf_dir), items).select("doc_id", "item_id", "n_shingles", "n_found")


OP4_SQL = """
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY 1)
SELECT d.id AS doc_id, i.id AS item_id, n_shingles, count(*) AS n_found
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.sh = i.sh JOIN n ON n.item_id = i.id
GROUP BY 1, 2, 3 HAVING count(*) * 100 >= n_shingles * 75
"""
