"""Sources mixed to target weights: weighted sampling by exponential keys, cut by prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import WORD, pick, word_count
from tablewright.llm.totals import running_totals

#: Characters that prose rarely has; a document of many of them weighs less.
SYMBOLS = "#$%&*|<>{}[]_=+~^@!"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Words each source gives: ``share`` of all words dealt by weight, none above ``most`` times its size.

    ``sizes`` has source and source_size. Sources stand by code point, null last, and weigh ``weights`` in
    turn. What a source can't take goes to the others by weight until none is above its limit. That fixed
    point needs no loop: by rising size over weight, the first k sources are at their limit, and prefix sums
    give the level of the rest. Returns source, source_size, target, first_word (words of the sources before).
    """
    ranked, totals = running_totals(sizes, [(F.col("source"), True)], {"rank": F.lit(1), "words": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before_rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", F.col("before_words").alias("first_word"), weight.cast("long").alias("weight"))

    by_ratio = [F.col("source_size") / F.col("weight"), (F.col("source"), True)]
    filled, all_of = running_totals(weighed, by_ratio, {"size": F.col("source_size"), "weight": F.col("weight")})
    whole = share * totals["words"]
    level = (F.lit(whole) - F.lit(float(most)) * F.col("before_size")) / (F.lit(all_of["weight"]) - F.col("before_weight"))
    full = F.lit(float(most)) * F.col("source_size") <= level * F.col("weight")
    filled = filled.withColumns({"level": level, "full": full})
    common = filled.filter(~F.col("full")).agg(F.max_by("level", -F.col("before_weight"))).first()[0]
    shared = F.lit(common).cast("double") * F.col("weight")
    target = F.when(F.col("full"), F.lit(float(most)) * F.col("source_size")).otherwise(shared)
    return filled.select("source", "source_size", target.alias("target"), "first_word")


def quality_weight(size: Column, text: Column) -> Column:
    """Words over words and symbol characters together: 1 for plain prose, less for markup and noise."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, size / (size + F.coalesce(symbols, F.lit(0)))).otherwise(F.lit(1.0))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """How many words of every document a mix takes: doc_id, source, size, source_size, target, taken.

    A document's key is -ln(u) / w (Efraimidis and Spirakis): u is drawn from a hash of seed and doc_id, w is
    ``quality_weight``. Whole epochs of a source come first; the rest of its target is filled in order of
    rising keys, and the document at the cut gives the words that still fit. So every source meets its target
    to the word, and no document exceeds ``most`` times its size. Sizes count words; null and empty texts have
    none and give none. A null source is a source. A null doc_id has the hash of the word null. Rows of
    one doc_id have one key and stand by size and checksum; equal rows are interchangeable. Runs agree. An
    empty table has no rows; extra columns are ignored. The order over all sources is one range partitioning,
    so a source of any size spreads over many tasks.
    """
    text, size = F.col("text"), F.col("size")
    rows = pick(docs, doc_id="long", text="string", source="string")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10)
    rows = rows.withColumn("size", word_count(text)).select(
        "doc_id",
        "source",
        "size",
        (-F.ln((draw.cast("long") + 1) / F.lit(2.0**52 + 1)) / quality_weight(size, text)).alias("key"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
    )
    order = [(F.col("source"), True), F.col("key"), F.col("doc_id"), F.col("size"), F.col("crc")]
    placed, _ = running_totals(rows, order, {"words": size})
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)

    of = targets.withColumnRenamed("source", "of_source")
    joined = placed.join(of, placed["source"].eqNullSafe(of["of_source"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0), F.least(size, rest - (F.col("before_words") - F.col("first_word"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * size + extra).alias("taken"), "crc")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The mixed corpus, with all columns of ``docs``: a document as often as the mix takes it whole, and the
    documents at a cut once more with the leading words that still fit (joined by one space).

    Rows are found again by doc_id, source, size and checksum; of equal rows any can be the cut one. An
    n_chars column follows the text.
    """
    keys = ("doc_id", "source", "size", "crc")
    plan = mix_plan(docs, weights, share, most, seed).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("long")
    plan = plan.withColumns({"whole": whole, "part": F.col("taken") - whole * F.col("size")})
    plan = plan.groupBy(*keys).agg(
        F.min("whole").alias("base"),
        F.max("whole").alias("top"),
        F.max("part").alias("part"),
        F.sum("whole").alias("sum"),
        F.count("*").alias("n"),
    )
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])

    have = {c.lower(): c for c in docs.columns}
    text = docs[f"`{have['text']}`"].cast("string")
    named = docs.select(
        docs[f"`{have['doc_id']}`"].cast("long").alias("_id"),
        (docs[f"`{have['source']}`"] if "source" in have else F.lit(None)).cast("string").alias("_source"),
        word_count(text).alias("_size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("_crc"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
    )
    own = ("_id", "_source", "_size", "_crc")
    same = F.lit(True)
    for mine, k in zip(own, keys, strict=True):
        same = same & F.col(mine).eqNullSafe(F.col(f"_mix_{k}"))
    turn = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1)))
    found = named.withColumn("_turn", turn).join(plan, same)
    more = F.col("_mix_sum") - F.col("_mix_base") * F.col("_mix_n")
    extra = F.when(F.col("_turn") <= more, F.col("_mix_top")).otherwise(F.col("_mix_base"))
    cut = F.when(F.col("_turn") == more + 1, F.col("_mix_part")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), extra.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<long>")))
    each = found.select("_row", F.explode(copies).alias("_words"))
    words = F.regexp_extract_all(F.col(f"_row.`{have['text']}`"), F.lit(f"({WORD})"), 1)
    taken = F.when(F.col("_words") >= 0, F.array_join(F.slice(words, 1, F.col("_words").cast("int")), " ")).otherwise(F.col(f"_row.`{have['text']}`"))
    out = each.withColumn("_text", taken)

    def field(c: str) -> Column:
        if c == have["text"]:
            return F.col("_text").alias(c)
        if c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            return F.when(F.col("_words") >= 0, F.length("_text").cast(kind)).otherwise(F.col(f"_row.`{c}`")).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    return out.select(*[field(c) for c in docs.columns])
