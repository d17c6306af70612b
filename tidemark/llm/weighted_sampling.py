"""Document fingerprints by consistent weighted sampling.

DataFrame functions only. A text is the weighted set of its words, the weight being the number of times a word stands in it. For each
of SAMPLES samples every word w of weight W draws r and c from Gamma(2, 1) and b from [0, 1), all three functions of word and sample
alone. With t = floor(ln W / r + b) and ln y = r (t - b), the word with the least ln c - ln y - r is the sample's outcome, together
with t. Two texts have equal outcomes with the probability of their generalised Jaccard similarity, the sum of the smaller
over the sum of the larger weights of all words.

Documents stand in ranges of their order, so that the next document is a neighbour in its range; one shuffle deals the texts to
their ranges, and words are gathered, weighted and sampled where they then lie.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle, unused

#: Samples of a fingerprint: an estimated likeness of 1/2 has a standard error of 0.09.
SAMPLES = 32
#: Bits of an outcome that a fingerprint keeps: different outcomes seem equal once in 65,536 times.
BITS = 16
_MASK = (1 << BITS) - 1
#: Bytes of text in a range of the order, and ranges at most.
RANGE_BYTES, RANGES = 8 << 20, 1 << 16
_FINE = 1 << 20


def words(text: Column) -> Column:
    """The words of a text; there may be an empty one at either end."""
    return F.split(text, r"[\x20\x09-\x0D]+", -1)


def _outcome(term: str, log_weight: str, k: int) -> Column:
    """ln of the sampled value in the upper bits, so that the least is the sample's, and the outcome in the lower BITS."""
    one, two = F.xxhash64(term, F.lit(k)), F.xxhash64(term, F.lit(~k))
    uniform = lambda h, shift: (F.shiftrightunsigned(h, shift) if shift else h).bitwiseAND(0xFFFFFF) + 0.5
    scale = 2.0**-48
    r = -F.log(uniform(one, 0) * uniform(one, 24) * scale)
    log_c = F.log(-F.log(uniform(two, 0) * uniform(two, 24) * scale))
    x = F.col(log_weight) / r + F.shiftrightunsigned(one, 48) * 2.0**-16
    t = F.floor(x)
    # ln c - r (t - b) - r, where r (t - b) is ln W less what floor() took away
    value = log_c - F.col(log_weight) - r * (1 - x + t)
    return F.shiftleft(F.floor(value * _FINE), BITS).bitwiseOR((F.col(term).bitwiseAND(_MASK) + t * 40503).bitwiseAND(_MASK))


def _hex(samples: list[Column]) -> Column:
    return F.coalesce(F.concat(*(F.lpad(F.lower(F.hex(s)), BITS // 4, "0") for s in samples)), F.lit(""))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal outcomes of two fingerprints; two empty ones are alike, an empty one and another are not."""
    step = BITS // 4
    equal = sum((F.substring(a, 1 + k * step, step) == F.substring(b, 1 + k * step, step)).cast("int") for k in range(samples))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(equal / samples)


def _sampled(terms: DataFrame, key: list[str], samples: int) -> DataFrame:
    """``key`` and the least values s0, s1, ... of all samples, for rows of a term and log_weight."""
    return terms.groupBy(*key).agg(*(F.min(_outcome("term", "log_weight", k)).alias(f"s{k}") for k in range(samples)))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with a fingerprint of ``text``: BITS / 4 hexadecimal digits a sample.

    Texts without a word, null ones too, have an empty fingerprint. Equal texts have equal ones. An empty table gives none; repeated rows
    are told apart by a number and each have theirs; all other columns pass, and one named ``out`` is replaced.
    """
    row, made_of = unused([*docs.columns, out], "row", "print")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    each = numbered.select(F.col(row).alias("row"), F.explode(words(F.col(text))).alias("word")).filter("word <> ''")
    terms = each.groupBy("row", F.xxhash64("word").alias("term")).agg(F.log(F.count("*")).alias("log_weight"))
    made = _sampled(terms, ["row"], samples)
    prints = made.select(F.col("row").alias(row), _hex([F.col(f"s{k}").bitwiseAND(_MASK) for k in range(samples)]).alias(made_of))
    kept = [F.col(c) for c in docs.columns if c != out]
    return numbered.join(prints, row, "left").select(*kept, F.coalesce(made_of, F.lit("")).alias(out))


_KEY = ("doc_id", "h")


def _ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with the range that they stand in, by doc_id (nulls first) and the text's hash; each range also has the next one's first row, with ``ahead`` set.

    The cuts between ranges come from a sort of ids and hashes alone. They are two numbers a range, RANGES at most, and are looked
    up in two steps. Which cuts are taken changes no result.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = settle(whole.select("doc_id", "h", F.octet_length("text").alias("bytes")))
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(1, min(RANGES, math.ceil(size / RANGE_BYTES)))
    spread = keys.repartitionByRange(ranges, F.asc_nulls_first("doc_id"), "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*_KEY)).alias("first"))
    firsts = sorted(((r["first"]["doc_id"], r["first"]["h"]) for r in spread.collect()), key=lambda k: (k[0] is not None, k))
    discard(keys)
    if not firsts:
        firsts = [(None, 0)]
    many = math.isqrt(len(firsts) - 1) + 1
    # the cuts as a table of rows of ``many``; a row's first cut finds the row
    rows = [[dict(zip(_KEY, k)) for k in firsts[i : i + many]] for i in range(0, len(firsts), many)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<struct<doc_id:bigint,h:bigint>>>")
    own = F.struct(*_KEY)
    coarse = F.greatest(F.size(F.filter(F.transform(table, lambda r: F.get(r, F.lit(0))), lambda c: c <= own)) - 1, F.lit(0))
    fine = F.greatest(F.size(F.filter(F.get(table, F.col("coarse")), lambda c: c <= own)) - 1, F.lit(0))
    placed = whole.withColumn("coarse", coarse).withColumn("range", F.col("coarse") * many + fine).drop("coarse")
    # a table that is read from files, as two uses of rows made here would not share their shuffle
    heads = settle(docs.sparkSession.createDataFrame([(*k, (i - 1) % len(firsts)) for i, k in enumerate(firsts)], "doc_id long, h long, range int"))
    own_key = [whole[c].eqNullSafe(heads[c]) for c in _KEY]
    ahead = whole.join(F.broadcast(heads), own_key[0] & own_key[1]).groupBy("range", heads["doc_id"], heads["h"]).agg(F.min("text").alias("text"))
    both = placed.select("range", "doc_id", "h", "text", F.lit(False).alias("ahead")).union(ahead.select("range", "doc_id", "h", "text", F.lit(True)))
    # never null, so that no test for it stands below one of two uses, which then would not share their shuffle
    return both.withColumn("range", F.coalesce("range", F.lit(0))), len(firsts)


def report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and those of the next document are.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many of the next document, or all of it.
    Documents follow each other by doc_id, a null one before all others, then by the text's hash and the text; after the last comes the first. A
    null text is an empty one; texts without a word have empty fingerprints, which are alike (1.0) among themselves and unlike (0.0) all others. Equal
    rows follow each other in any order, as nothing tells them apart; an empty table gives no rows. Very long texts are
    taken whole.
    """
    both, ranges = _ordered(docs)
    dealt = both.repartition(ranges, "range")
    place = Window.partitionBy("range").orderBy("ahead", F.asc_nulls_first("doc_id"), "h", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    following = F.lead("text").over(place)
    rows = dealt.select("range", F.row_number().over(place).alias("row"), "ahead", "doc_id", "text", following.alias("following"))
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))
    known = rows.select("range", "row", "ahead", "doc_id", "text", F.when(~F.col("ahead"), edited).alias("edited"))
    each = known.select("range", "row", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("text").alias("of")), F.struct(F.lit(False).alias("own"), F.col("edited").alias("of")))).alias("v"))
    each = each.select("range", "row", "v.own", F.explode(words(F.col("v.of"))).alias("word")).filter("word <> ''")
    counts = each.groupBy("range", "row", F.xxhash64("word").alias("term")).agg(F.count_if("own").alias("n"), F.count_if(~F.col("own")).alias("m"))
    # a word that stands equally often in both texts is drawn once for the two
    used = lambda n, m, weight: F.struct(F.lit(n).alias("in_text"), F.lit(m).alias("in_edited"), F.col(weight).alias("weight"))
    parts = F.when(F.col("n") == F.col("m"), F.array(used(True, True, "n"))).when(F.col("m") == 0, F.array(used(True, False, "n"))).when(F.col("n") == 0, F.array(used(False, True, "m"))).otherwise(F.array(used(True, False, "n"), used(False, True, "m")))
    terms = counts.select("range", "row", "term", F.explode(parts).alias("v")).select("range", "row", "term", "v.in_text", "v.in_edited", F.log("v.weight").alias("log_weight"))
    least = _sampled(terms, ["range", "row", "in_text", "in_edited"], samples)
    made = least.groupBy("range", "row").agg(
        *(F.min(F.when(F.col("in_text"), F.col(f"s{k}"))).bitwiseAND(_MASK).alias(f"t{k}") for k in range(samples)),
        *(F.min(F.when(F.col("in_edited"), F.col(f"s{k}"))).bitwiseAND(_MASK).alias(f"e{k}") for k in range(samples)),
    ).select("range", "row", _hex([F.col(f"t{k}") for k in range(samples)]).alias("fingerprint"), _hex([F.col(f"e{k}") for k in range(samples)]).alias("edited_fingerprint"))
    facts = known.select("range", "row", "ahead", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    joined = facts.join(made, ["range", "row"], "left").fillna("", ["fingerprint", "edited_fingerprint"])
    following = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("row")).alias("next_fingerprint")
    done = joined.select("*", following).filter(~F.col("ahead"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next_fingerprint", samples).alias("near_next"),
    )
