"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regesta.session import folder_names, materialise_with

WORD = 64
#: Rows of all snapshots that a bucket is laid out for: what one task sorts, and the room a bucket has to grow in.
BUCKET_ROWS = 100_000


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def assign_ordinals(keyed: DataFrame, keys: list[str], known: DataFrame | None, buckets: int) -> DataFrame:
    """Give each key an ordinal that it keeps.

    keyed: keys and _snap. A key lives in one of `buckets` buckets by its hash and gets the next free ordinal of that bucket, in the order of the
    snapshot in which it first appears, so that keys which come together stand together, and later snapshots change no ordinal. Keys of `known` (bucket, keys,
    ordinal, as kept from earlier snapshots, made with the same buckets) keep theirs. A bucket is the unit of sorting.
    Result: keyed plus bucket, ordinal, and _new: one row of each key that is not in known has it true.
    """
    placed = keyed.withColumn("bucket", _bucket(keys, buckets))
    if known is not None:
        top = known.groupBy("bucket").agg((F.max("ordinal") + 1).alias("_next"))
        placed = placed.join(known.select("bucket", *keys, F.col("ordinal").alias("_kept")), ["bucket", *keys], "left").join(top, "bucket", "left")
    else:
        placed = placed.withColumns({"_kept": F.lit(None).cast("long"), "_next": F.lit(0).cast("long")})
    placed = placed.repartition("bucket").withColumn("_first", F.min("_snap").over(Window.partitionBy("bucket", *keys)))
    fresh = F.col("_kept").isNull()
    rank = F.dense_rank().over(Window.partitionBy("bucket", fresh).orderBy("_first", *keys)) - 1
    ordinal = F.when(fresh, F.coalesce(F.col("_next"), F.lit(0)) + rank).otherwise(F.col("_kept")).cast("long")
    return placed.withColumn("ordinal", ordinal).withColumn("_new", fresh & (F.col("_snap") == F.col("_first"))).drop("_kept", "_next", "_first")


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None, int]:
    """(bucket, keys, ordinal of all keys kept so far; the number of buckets; how many parts there are). A part counts once it was written whole."""
    made = [(int(b.split("=")[1]), n) for b in folder_names(spark, path) if b.startswith("buckets=") for n in folder_names(spark, f"{path}/{b}", whole=True)]
    if not made:
        return None, None, 0
    buckets = made[0][0]
    return spark.read.parquet(*(f"{path}/buckets={buckets}/{n}" for _, n in sorted(made))), buckets, len(made)


def key_dictionary(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """bucket, keys, ordinal of the keys that are new: to keep for the next snapshots."""
    return ordered.where("_new").select("bucket", *keys, "ordinal")


def _set_bits(word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(word, i) == 1)


def snapshot_changes(rows: DataFrame, keys: list[str], snapshot: str, value: str, version: str, *, dictionary: str | None = None, buckets: int | None = None) -> DataFrame:
    """Which keys were added, withdrawn or altered from each snapshot to the next.

    rows: keys, snapshot, value (null: unknown), version (of several rows of a key in one snapshot the one with the
    greatest version among those with a value counts; ties: the greatest value). Result: snapshot (the later one),
    keys, changement ('ajoutee', 'retiree' or 'modifiee': known and different in both).

    Keys become ordinals, which a dictionary keeps from run to run: a folder to which each run adds the keys that are new (one run at a time; without a folder
    the ordinals live as long as the run). The number of buckets follows from the rows of the first run (BUCKET_ROWS) and stays. A snapshot becomes a bitmap of ordinals,
    in 64-bit words; words without a bit do not exist, and as ordinals follow the order of appearance, words are full or absent rather than thin. Beside
    each word stands a vector of hashes (96 bits) of its values in the order of ordinals. A word meets that of the
    snapshot before it: AND-NOT one way gives additions, the other way withdrawals, and where both have a bit
    the two vectors show whether the values differ.

    What moves is one row for a key and snapshot, twice (to its bucket, to its word), and finally the changed ordinals and the keys, where they meet.
    Rows with a null snapshot or a null key are left out. An empty table, or one snapshot, gives no change. The
    list of different snapshots is all that comes to the driver.
    """
    spark = rows.sparkSession
    clean = rows.select(*keys, F.col(snapshot).alias("_snap"), F.col(value).alias("_value"), F.col(version).alias("_version")).dropna(subset=[*keys, "_snap"])
    latest = F.max(F.when(F.col("_value").isNotNull(), F.struct("_version", "_value")))["_value"]
    # copies of a row meet in the map tasks already, so a hot key moves as one row per task
    one = clean.groupBy(*keys, "_snap").agg(latest.alias("_value"))
    hashed = F.when(F.col("_value").isNotNull(), F.struct(F.xxhash64("_value").alias("h"), F.hash("_value").alias("g")))
    known, kept_buckets, parts = read_dictionary(spark, dictionary) if dictionary else (None, None, 0)
    buckets = kept_buckets or buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    ordered, seen = materialise_with(
        assign_ordinals(one.select(*keys, "_snap", hashed.alias("_value")), keys, known, buckets).select("bucket", "ordinal", *keys, "_snap", "_value", "_new"), "ordinals", snaps=F.collect_set("_snap"), fresh=F.count_if("_new")
    )
    if dictionary and seen["fresh"]:
        key_dictionary(ordered, keys).write.mode("overwrite").parquet(f"{dictionary}/buckets={buckets}/{parts:08d}")
    snaps = sorted(seen["snaps"] or [])
    if len(snaps) < 2:
        return ordered.limit(0).select(F.col("_snap").alias(snapshot), *keys, F.lit("").alias("changement"))
    index = spark.createDataFrame(list(enumerate(snaps)), f"_i int, _snap {ordered.schema['_snap'].dataType.simpleString()}")

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("ordinal", F.lit(WORD)).cast("int"))
    numbered = ordered.join(F.broadcast(index), "_snap").select("bucket", F.floor(F.col("ordinal") / WORD).alias("word"), "_i", "ordinal", "_value")
    # all snapshots of a word are in one task: there are no more than its 64 keys have
    words = numbered.repartition("bucket", "word").groupBy("bucket", "word", "_i").agg(
        F.bit_or(bit).alias("bits"), F.sort_array(F.collect_list(F.struct(F.pmod("ordinal", F.lit(WORD)).cast("int").alias("at"), F.col("_value").alias("v")))).alias("vector")
    )
    w = Window.partitionBy("bucket", "word").orderBy("_i")
    none = F.lit(0).cast("long")
    follows = F.lag("_i").over(w) == F.col("_i") - 1
    pair = words.select(
        "bucket", "word", "_i", F.col("bits").alias("cur"), F.col("vector").alias("cur_v"), F.when(follows, F.lag("bits").over(w)).otherwise(none).alias("prev"), F.when(follows, F.lag("vector").over(w)).alias("prev_v"),
        F.coalesce(F.lead("_i").over(w) != F.col("_i") + 1, F.lit(True)).alias("ends"),
    )
    added = F.col("cur").bitwiseAND(F.bitwise_not(F.col("prev")))
    gone = F.col("prev").bitwiseAND(F.bitwise_not(F.col("cur")))
    both = F.col("cur").bitwiseAND(F.col("prev"))

    def aligned(vector: str) -> Column:
        """The values of the common keys only, in the order of ordinals: two such vectors are of one length."""
        return F.filter(F.col(vector), lambda s: F.getbit(both, s["at"]) == 1)

    differ = F.zip_with(aligned("cur_v"), aligned("prev_v"), lambda a, b: F.struct(a["at"].alias("at"), (a["v"] != b["v"]).alias("d")))
    altered = F.when(both == 0, F.array().cast("array<int>")).otherwise(F.transform(F.filter(differ, lambda s: s["d"]), lambda s: s["at"]))
    nothing = F.array().cast("array<int>")
    later = F.col("_i") > 0  # the first snapshot has none before it
    kinds = F.array(
        F.struct(F.col("_i").alias("i"), F.lit("ajoutee").alias("changement"), F.when(later, _set_bits(added)).otherwise(nothing).alias("bits")),
        F.struct(F.col("_i").alias("i"), F.lit("retiree").alias("changement"), F.when(later, _set_bits(gone)).otherwise(nothing).alias("bits")),
        F.struct(F.col("_i").alias("i"), F.lit("modifiee").alias("changement"), F.when(later, altered).otherwise(nothing).alias("bits")),
        # a word that the next snapshot does not have is gone whole
        F.struct((F.col("_i") + 1).alias("i"), F.lit("retiree").alias("changement"), F.when(F.col("ends") & (F.col("_i") < len(snaps) - 1), _set_bits(F.col("cur"))).otherwise(nothing).alias("bits")),
    )
    changed = (
        pair.select("bucket", "word", F.explode(kinds).alias("k"))
        .select("bucket", "word", F.col("k.i").alias("_i"), "k.changement", F.explode("k.bits").alias("at"))
        .select("bucket", (F.col("word") * WORD + F.col("at")).alias("ordinal"), "_i", "changement")
    )
    names = key_dictionary(ordered, keys) if known is None else known.select("bucket", *keys, "ordinal").unionByName(key_dictionary(ordered, keys))
    return changed.join(names, ["bucket", "ordinal"]).join(F.broadcast(index), "_i").select(F.col("_snap").alias(snapshot), *keys, "changement")
