"""One record for each group of records that stand for one page, built field by field.

Records are linked through the addresses they name.  A link that only a canonical_url makes counts
if the texts agree but for a paragraph or two: candidates share an address and one of the three
lines that are rarest there (of two line sets that differ by at most two on either side, one of
these must be shared), so no group is paired out; equal texts are linked as one.  Groups are the
connected components.

Values of a group's fields are judged by a latent two-sided quality model.  Each kind of source
(extraction method and confidence) asserts the values its records hold and denies the group's
other values; sensitivity and specificity of each source and the truth of each value are inferred
by expectation-maximisation.  A multi-valued field keeps every value judged true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import address_key
from webloom.operators.components import connected_components
from webloom.scratch import Scratch

PARAGRAPHS, ROUNDS, SETTLED, MOST_SOURCES = 2, 8, 1e-3, 256
PRIOR = {"true": (2.0, 2.0), "sensitivity": (4.0, 2.0), "specificity": (9.0, 1.0)}


def text_lines(text: Column) -> Column:
    """Hashes of the lines with something on them, blanks and case aside."""
    plain = F.filter(F.split(F.regexp_replace(F.lower(text), r"[\t  ]+", " "), "\n"), lambda x: F.trim(x) != "")
    return F.transform(plain, lambda x: F.xxhash64(F.trim(x)))


def _address_links(scratch: Scratch, recs: DataFrame) -> DataFrame:
    """(a, b) of records that belong together; a node is struct(run_id, url_id)."""
    node = F.struct("run_id", "url_id").alias("node")
    own = recs.where("u is not null").select("run_id", F.col("u").alias("address"), node, F.lit(True).alias("own"), "lines")
    said = recs.where("c is not null and (u is null or c <> u)").select("run_id", F.col("c").alias("address"), node, F.lit(False).alias("own"), "lines")
    named = own.unionByName(said)
    shared = named.groupBy("run_id", "address").agg(F.count("*").alias("n"), F.count_if(~F.col("own")).alias("said"), F.min(F.when(F.col("own"), F.col("node"))).alias("hub")).where("n > 1")
    named = scratch.cut(named.join(shared, ["run_id", "address"]), "named")
    by_url = named.where("own").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # canonical links: one entry for each different text at an address
    texts = named.where("said > 0 and size(lines) > 0").groupBy("run_id", "address", F.array_sort("lines").alias("lines")).agg(F.min("node").alias("node"), F.bool_or("own").alias("own"), F.bool_or(~F.col("own")).alias("said"))
    texts = scratch.cut(texts.withColumn("text", F.xxhash64("run_id", "address", "lines")), "texts")
    same = named.where("said > 0 and size(lines) > 0").select("node", F.xxhash64("run_id", "address", F.array_sort("lines")).alias("text")).join(texts.select("text", F.col("node").alias("hub")), "text")
    by_text = same.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    each = texts.select("run_id", "address", "text", F.explode(F.array_distinct("lines")).alias("line"))
    rare = each.join(each.groupBy("run_id", "address", "line").agg(F.count("*").alias("n")), ["run_id", "address", "line"])
    heads = rare.groupBy("run_id", "address", "text").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "line"))), 1, PARAGRAPHS + 1).alias("heads"))
    keys = heads.select("text", F.explode("heads").alias("h"), "run_id", "address").select("text", "run_id", "address", F.col("h.line").alias("line"))
    # a line that many texts share is first settled against the least of them; only what differs from that one is paired
    keys = scratch.cut(keys.join(texts.select("text", "lines", "own", "said", "node"), "text"), "keys")
    lead = keys.groupBy("run_id", "address", "line").agg(F.min(F.struct("text", "lines", "own", "said", "node")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    led = scratch.cut(keys.join(lead, ["run_id", "address", "line"]), "led")
    close = _close(F.col("lines"), F.col("lead.lines")) & (F.col("said") | F.col("lead.said"))
    led = led.withColumn("close", close)
    by_lead = led.where("close and text <> lead.text").select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
    odd = led.where("not close and text <> lead.text").select("run_id", "address", "line", *(F.col(c).alias(f"{c}2") for c in ("text", "lines", "said", "node")))
    met = odd.join(led, ["run_id", "address", "line"]).where("text2 <> text").where(_close(F.col("lines"), F.col("lines2")) & (F.col("said") | F.col("said2")))
    return by_url.unionByName(by_text).unionByName(by_lead).unionByName(met.select(F.col("node2").alias("a"), F.col("node").alias("b")))


def _close(a: Column, b: Column) -> Column:
    """Sorted line arrays that share a line and differ by PARAGRAPHS at most on either side, repeats counted."""
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return (both > 0) & (F.size(a) - both <= PARAGRAPHS) & (F.size(b) - both <= PARAGRAPHS)


def source_quality(claims: DataFrame, rounds: int = ROUNDS, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, dict[str, tuple[float, float]], float]:
    """Truth of each fact, (sensitivity, specificity) of each source, and the share of true facts.

    claims: fact, source, says (boolean), n.  Facts with the same claims are one case; rounds run over cases until no
    quality moves by more than SETTLED, or ``rounds`` times.  Sources beyond ``most_sources`` in number of claims are judged together as one.
    """
    scratch = Scratch(claims.sparkSession)
    often = [r.source for r in claims.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(most_sources).collect()]
    if not often:
        return claims.select("fact", F.lit(0.0).alias("truth")), {}, 0.5
    pooled = claims.withColumn("source", F.when(F.col("source").isin(often), F.col("source")).otherwise("other"))
    grouped = pooled.groupBy("fact", "source").agg(F.sum(F.when(F.col("says"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("says"), 0).otherwise(F.col("n"))).alias("no"))
    facts = grouped.groupBy("fact").agg(F.array_sort(F.collect_list(F.struct("source", "yes", "no"))).alias("claims"))  # no more than most_sources + 1 each
    facts = scratch.cut(facts, "facts")
    cases = scratch.cut(facts.groupBy("claims").agg(F.count("*").alias("n")), "cases")
    quality, share = dict.fromkeys([*often, "other"], (0.7, 0.9)), 0.5
    mean = lambda yes, no, prior: (yes + prior[0]) / (yes + no + sum(prior))

    def truth() -> Column:
        weights = F.create_map(*(x for s, (sens, spec) in quality.items() for x in (F.lit(s), F.struct(F.lit(math.log(sens / (1 - spec))).alias("yes"), F.lit(math.log((1 - sens) / spec)).alias("no")))))
        start = F.lit(math.log(share / (1 - share)))
        odds = F.aggregate("claims", start, lambda s, x: s + x["yes"] * weights[x["source"]]["yes"] + x["no"] * weights[x["source"]]["no"])
        return 1 / (1 + F.exp(-odds))

    for _ in range(rounds):
        all_facts = F.array(F.struct(F.lit("").alias("source"), F.lit(1).cast("long").alias("yes"), F.lit(0).cast("long").alias("no")))  # counted as a source without a name
        judged = cases.withColumn("truth", truth()).select("n", "truth", F.explode(F.concat("claims", all_facts)).alias("c"))
        t, n = F.col("truth"), F.col("n")
        sums = judged.groupBy("c.source").agg(*(F.sum(n * w * F.col(f"c.{k}")).alias(name) for name, w, k in (("ty", t, "yes"), ("tn", t, "no"), ("fy", 1 - t, "yes"), ("fn", 1 - t, "no"))))
        before = dict(quality)
        for r in sums.collect():  # one row a source
            if r.source:
                quality[r.source] = mean(r.ty, r.tn, PRIOR["sensitivity"]), mean(r.fn, r.fy, PRIOR["specificity"])
            else:
                share = mean(r.ty, r.fy, PRIOR["true"])
        if max(abs(a - b) for s in quality for a, b in zip(quality[s], before[s])) <= SETTLED:
            break
    return facts.select("fact", truth().alias("truth")), quality, share


def _claims(members: DataFrame, field: str) -> DataFrame:
    """Assertions and denials of the values of one field within each group."""
    said = members.where(F.col(field).isNotNull()).groupBy("run_id", "group_id", F.lit(field).alias("field"), F.col(field).cast("string").alias("value"), "source").agg(F.count("*").alias("n"))
    totals = said.groupBy("run_id", "group_id", "source").agg(F.sum("n").alias("all"))
    values = said.select("run_id", "group_id", "field", "value").distinct()
    met = values.join(totals, ["run_id", "group_id"]).join(said, ["run_id", "group_id", "field", "value", "source"], "left")
    met = met.withColumn("fact", F.struct("run_id", "group_id", "field", "value"))
    yes = F.coalesce(F.col("n"), F.lit(0))
    pair = F.explode(F.array(F.struct(F.lit(True).alias("says"), yes.alias("n")), F.struct(F.lit(False).alias("says"), (F.col("all") - yes).alias("n"))))
    return met.select("fact", "source", pair.alias("x")).select("fact", "source", "x.says", "x.n").where("n > 0")


def prepare(rows: DataFrame) -> dict[str, Column]:
    """What ``representatives`` needs of a record, as expressions over the raw columns."""
    blank = lambda c: F.when(F.trim(F.regexp_replace(c, r"[\s ]+", " ")) != "", F.col(c))
    source = F.concat_ws("/", F.coalesce("extraction_method", F.lit("none")), F.coalesce("signal_confidence", F.lit("none")))
    return {
        "u": address_key(F.col("url")), "c": address_key(F.col("canonical_url")), "lines": text_lines(F.col("main_text")), "title": blank("title"), "canonical": blank("canonical_url"),
        "url": F.col("url"), "code": F.lower(F.trim("hreflang_code")), "words": F.coalesce("word_count", F.lit(0)), "off": ~F.coalesce(F.col("status") == 200, F.lit(False)), "source": source,
    }


def representatives(recs: DataFrame) -> DataFrame:
    """One row per group of two or more records (columns of ``prepare`` and run_id, url_id).

    run_id, group_id (smallest url_id), survivor_id, title_id, canonical_id (-1: nobody has one), n_members, and
    the record built: title, words, canonical and codes with every value judged true, and ``sure``, the truth of
    the title kept.  Members are ordered by status 200, words, shorter url, url, url_id; null urls come last, null
    texts support no canonical link.  Among titles of about the same truth the first member's is kept.
    """
    return judged(recs)[0]


def judged(recs: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The rows of ``representatives`` and (sensitivity, specificity) of each source."""
    scratch = Scratch(recs.sparkSession)
    recs = scratch.cut(recs, "records")
    groups = connected_components(_address_links(scratch, recs))
    groups = groups.select(F.col("node.run_id"), F.col("node.url_id"), F.col("component.url_id").alias("group_id"))
    members = recs.select("run_id", "url_id", "title", "canonical", "c", "url", "code", "words", "off", "source").join(groups, ["run_id", "url_id"])
    order = F.struct("off", -F.col("words"), F.col("url").isNull(), F.length("url"), "url", "url_id")
    members = scratch.cut(members.withColumn("order", order), "members")
    first = lambda test: F.coalesce(F.min(F.when(test, F.col("order")))["url_id"], F.lit(-1).cast("long"))
    picked = members.groupBy("run_id", "group_id").agg(
        F.min("order")["url_id"].alias("survivor_id"), first(F.col("title").isNotNull()).alias("title_id"), first(F.col("canonical").isNotNull()).alias("canonical_id"),
        F.count("*").alias("n_members"), F.max("words").alias("words"),
    ).where("n_members > 1")
    claims = _claims(members, "title").unionByName(_claims(members, "c")).unionByName(_claims(members, "code"))
    truth, quality, _ = source_quality(claims)
    truth = scratch.cut(truth.select("fact.*", "truth"), "truth")
    place = members.where("title is not null").groupBy("run_id", "group_id", F.col("title").alias("value")).agg(F.min("order").alias("order"))
    titles = truth.where("field = 'title'").join(place, ["run_id", "group_id", "value"]).groupBy("run_id", "group_id").agg(F.min(F.struct(-F.round("truth", 2), F.col("order"), "value", "truth")).alias("best"))
    titles = titles.select("run_id", "group_id", F.col("best.value").alias("title"), F.col("best.truth").alias("sure"))
    kept = truth.where("field <> 'title' and truth >= 0.5").groupBy("run_id", "group_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(name) for f, name in (("c", "canonicals"), ("code", "codes"))))
    return picked.join(titles, ["run_id", "group_id"], "left").join(kept, ["run_id", "group_id"], "left"), quality
