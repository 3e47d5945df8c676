"""SimHash document fingerprints with permuted block tables, in DataFrame expressions only.

Terms are five-word shingles (at a text's end also the shorter ones), weighted by how often they
occur. Each term's 64-bit hash votes on 64 signed bits. Four votes are counted in one long, in
lanes of 16 bits, so a term costs 16 additions instead of 64.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import durable
from tidepanel.llm.graph import components

WIDTH, BITS, LANE_BITS = 5, 64, 16
LANES = BITS // 4
LANE_MASK = 0x0001000100010001
#: Terms that are counted in one set of lanes at most: a lane must stay below 2**15.
CHUNK_SHIFT = 14
#: Fingerprints this near are linked, and the blocks whose pairs make the tables: radius + 2, so that two stay untouched.
RADIUS, BLOCKS = 3, (13, 13, 13, 13, 12)


def _one(bit: int) -> Column:
    value = 1 << bit
    return F.lit(value if value < 1 << 63 else value - (1 << 64)).cast("long")


def votes(rows: DataFrame, keys: list[str], text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carry, bits): the fingerprint of ``text`` for each row, as a long; 0 without words.

    ``keys`` tell the rows apart; where the input is dealt out by some of them nothing is shuffled.
    ``carry`` are long columns that come along: read at a text's first term, so that neither keys
    grow nor a join has to bring them back.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = rows.select(*keys, *carry, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    terms = hashed.select(*keys, *carry, F.transform("_h", lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, WIDTH)])).alias("_t"))
    # outer: a plain explode makes the optimizer test the array's size below the projections, inlining all of the above
    single = terms.select(*keys, *carry, F.posexplode_outer("_t").alias("_p", "_t")).withColumn("_c", F.shiftright("_p", CHUNK_SHIFT))
    first = F.coalesce("_p", F.lit(0)) == 0
    packed = single.groupBy(*keys, "_c").agg(
        F.count("_t").alias("_n"), *[F.max(F.when(first, F.col(c))).alias(c) for c in carry], *[F.sum(F.shiftrightunsigned("_t", i).bitwiseAND(F.lit(LANE_MASK))).alias(f"_s{i}") for i in range(LANES)]
    )
    count = {i + LANES * lane: F.shiftrightunsigned(f"_s{i}", LANE_BITS * lane).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) for i in range(LANES) for lane in range(4)}
    summed = packed.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.max(c).alias(c) for c in carry], *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_b{b}") for b, c in count.items()])
    bits = [F.when(F.col(f"_b{b}") * 2 > F.col("_n"), _one(b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return summed.select(*keys, *carry, reduce(Column.bitwiseOR, bits).alias("bits"))


def shown(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): one row per row; texts without words have all bits 0, and null is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = durable(rows)
    return rows.join(votes(rows, ["_row"], "text"), "_row", "left").select("doc_id", shown(F.coalesce("bits", F.lit(0).cast("long"))).alias("fingerprint"))


def _table_keys(bits: Column) -> list[Column]:
    """For each pair of blocks, the table's number and the pair's bits: what a permutation would bring to the front."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(bits, s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in zip(starts, BLOCKS, strict=True)]
    return [F.struct(F.lit(t).alias("table"), block[i].alias("one"), block[j].alias("two")) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]


def near_links(points: DataFrame) -> DataFrame:
    """(a, b): links between distinct ``bits`` that connect just what radius-3 links connect.

    First every fingerprint is filed under itself and its 64 one-bit variants: those that meet are
    2 bits apart at most, and linking each to the least of them is as good as linking all pairs.
    What is still unconnected goes through the block tables: 3 differing bits leave two of five
    blocks equal. Buckets of a single component have nothing to find and are left out.
    """
    # the table is small by now, and adaptive execution has packed it into few partitions: deal it out before it grows
    wide = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartition(wide, "bits")
    variants = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(_one(b)) for b in range(BITS)])
    filed = points.select("bits", F.explode(variants).alias("at"))
    least = filed.groupBy("at").agg(F.min("bits").alias("b"), F.max("bits").alias("most")).where("b <> most").select("at", "b")
    stars = durable(filed.join(least, "at").where("bits <> b").select(F.col("bits").alias("a"), "b").distinct())
    close = components(stars)
    placed = points.join(close.withColumnRenamed("node", "bits"), "bits", "left").select("bits", F.coalesce("component", "bits").alias("comp"))
    tables = durable(placed).repartition(wide, "bits").select("bits", "comp", F.explode(F.array(*_table_keys(F.col("bits")))).alias("key")).select("bits", "comp", "key.*")
    keys = ["table", "one", "two"]
    live = tables.groupBy(*keys).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(*keys)
    active = tables.join(live, keys, "left_semi")
    left, right = active.alias("l"), active.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    far = left.join(right, reduce(Column.__and__, same) & (F.col("l.comp") < F.col("r.comp")) & (F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= RADIUS))
    return stars.unionByName(far.select(F.col("l.bits").alias("a"), F.col("r.bits").alias("b")).distinct())


def near_classes(prints: DataFrame) -> DataFrame:
    """(bits, class_id): for each fingerprint the smallest doc_id of those it reaches in steps of RADIUS bits."""
    points = durable(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    reach = components(near_links(points.select("bits"))).withColumnRenamed("node", "bits")
    named = points.join(reach, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    ids = named.groupBy("component").agg(F.min("first").alias("class_id"))
    return named.join(ids, "component").select("bits", "class_id")


def _beside(docs: DataFrame) -> DataFrame:
    """(bucket, rn, guard, doc_id, text, next_text): each row with the next one by descending doc_id.

    Ids are cut into ranges at approximate quantiles, and each range is a window of its own. The
    first rows of the next lower range join it as guards, so that its last row finds its successor;
    the lowest range gets the first of all.
    """
    spark = docs.sparkSession
    n = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]  # n numbers, as many as there are ranges
    cuts = sorted(set(cuts or ()))
    top = 1 << len(cuts).bit_length()
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())])
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.coalesce(
        F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.lit(len(cuts))) & (F.get(bounds, low + step - 1) <= F.col("doc_id")), low + step).otherwise(low)),
        F.lit(-1),
    )
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()  # a row for each range
    order = sorted((r["bucket"], r["first"]) for r in firsts)
    follow = [(order[(i + 1) % len(order)][0], None if f is None else int(f), b) for i, (b, f) in enumerate(order)]  # the range above takes b's first rows
    guards = F.broadcast(spark.createDataFrame(follow, "to int, first long, `from` int"))
    extra = rows.join(guards, (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guard"))
    whole = rows.select("doc_id", "text", "bucket", F.lit(False).alias("guard")).unionByName(extra)
    w = Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").desc_nulls_last(), "text")
    return whole.select("bucket", F.row_number().over(w).alias("rn"), "guard", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, their likeness, the next text's, and the near class.

    Repeated rows each get their row; they follow each other by text. A null doc_id comes last in
    the order. Of a table of one row the row is its own successor. class_id is the smallest doc_id
    among the documents whose fingerprints connect to this one's within RADIUS bits.
    """
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = _beside(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    sha = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"q{i}") for i in range(4)]
    facts = ("doc_id", "n_chars", "guarding", "q0", "q1", "q2", "q3")
    rows = rows.select("bucket", "rn", "doc_id", "n_chars", F.col("guard").cast("long").alias("guarding"), *quarters, "text", "edited")
    both = rows.select("bucket", "rn", *facts, F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("e")).select("bucket", "rn", *facts, "e.*")
    voted = votes(both, ["bucket", "rn", "kind"], "text", facts)
    joined = voted.groupBy("bucket", "rn").agg(*[F.max(c).alias(c) for c in facts], F.max(F.when(F.col("kind") == 0, F.col("bits"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("bits"))).alias("changed"))
    w = Window.partitionBy("bucket").orderBy("rn")
    joined = joined.withColumn("edited_sha256", F.lower(F.concat(*[F.lpad(F.hex(f"q{i}"), 16, "0") for i in range(4)])))
    done = durable(joined.withColumn("after", F.lead("own").over(w)).where("guarding = 0").select("doc_id", "n_chars", "edited_sha256", "own", "changed", "after"))
    classes = near_classes(done.select(F.col("own").alias("bits"), "doc_id"))
    return done.join(classes.withColumnRenamed("bits", "own"), "own", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        "class_id",
    )
