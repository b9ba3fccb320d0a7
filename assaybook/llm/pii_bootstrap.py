"""Personal data by bootstrapped contextual extraction (DataFrame code only).

Seeds are what the exact forms of four kinds find: e-mail addresses, IP
addresses, card numbers, phone numbers. Candidates are looser forms of the same
kinds (obfuscated addresses, numbers without their country code, wrong check
digits) that overlap no seed. Every mention, seed or candidate, induces lexical
patterns: the word before it, the two words before it, the word after it.

Patterns and instances (a mention's digits or lower-case address) form a graph,
scored in rounds. A pattern's confidence is the lower Wilson bound of the trusted
share of its distinct instances; it counts with enough trusted instances and if
a large share of the places in all texts where its words stand lead to a form
of its kind (so that common words are no pattern). An instance's score is the
noisy-or of its confident patterns; in the next round it supports its other
patterns by that score. Candidates whose instance ends up trusted, by patterns
or because it is a seed's instance in another form, become spans.

Positions come from the gaps between matches: a match starts after the gaps and
matches before it. The forms are written without backtracking and never
start inside a run they just refused, so long texts cost linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaybook.llm.common import stage, table, text_or_empty

#: Fixed values of the contract: kinds in order, and their exact forms. A form
#: begins where the match before it ended or where its first run of characters does.
KINDS = ("email", "ip", "card", "phone")
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[({]\x20?(?:@|at|AT)\x20?[\])}]\x20?)"
              r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:\.|dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]++)*+"),
    "ip": (r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\.|\x20?[\[({]\x20?(?:\.|dot|DOT)\x20?[\])}]\x20?)[0-9]{1,3}){3}"
           r"(?![A-Za-z0-9])|(?<![A-Za-z0-9:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![A-Za-z0-9:])"),
    "card": r"(?<![A-Za-z0-9])[0-9](?:[\x20.-]?+[0-9]){11,18}+(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,14}+(?![A-Za-z0-9])"}

#: What a text must hold for a form to match at all.
_DIGIT = r"[0-9]"
NEEDS = {("email", False): "@", ("ip", False): r"[0-9]\.[0-9]", ("card", False): _DIGIT, ("phone", False): r"\+[0-9]",
         ("email", True): r"@|[\[({]\x20?(?:at|AT)", ("ip", True): "[0-9:]", ("card", True): _DIGIT, ("phone", True): _DIGIT}

#: A pattern needs this many distinct trusted instances, this lower bound of their
#: share, and this share of its places in all texts that lead to a form of its kind.
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SELECTIVE = 5, 0.5, 0.5
#: An instance is trusted from this score on.
LEAST_SCORE = 0.5
ROUNDS = 4
#: Characters on each side of a mention in which its context words are looked for.
CONTEXT = 200


# ---------------------------------------------------------------- mentions
def _matches(text: Column, kind: int, loose: bool) -> Column:
    """Gaps and matches of one form in text order (null without a match); the
    last entry holds the gap after the last match."""
    form = F.lit((LOOSE if loose else EXACT)[KINDS[kind]])
    hits = F.regexp_extract_all(text, form, F.lit(0))
    zipped = F.arrays_zip(F.split(text, form, -1).alias("gap"), hits.alias("hit"))
    parts = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), i.alias("n"),
        F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"),
        F.substring(x["gap"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["gap"], 1, CONTEXT).alias("after"),
        x["hit"].alias("hit")))
    # most texts hold nothing: one look for a character spares them the form
    return F.when(text.rlike(NEEDS[KINDS[kind], loose]), F.when(F.size(hits) > 0, parts))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: Column, hit: Column) -> Column:
    """The contract's checks of what an exact form matched."""
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    small = lambda p: F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"
    parts = F.split(hit, r"\.")
    n = F.length(_digits(hit))
    return (F.when(kind == 0, True)
            .when(kind == 1, F.forall(parts, part) & F.forall(parts, small))
            .when(kind == 2, n.between(14, 19) & F.call_function("luhn_check", F.substring(_digits(hit), 1, 20)))
            .otherwise(n.between(10, 15)))


def _instance(kind: Column, hit: Column) -> Column:
    """A mention's identifier in one spelling."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(hit), r"\x20?[\[({]\x20?(?:@|at)\x20?[\])}]\x20?", "@"),
                             r"\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?", ".")
    return F.when(kind <= 1, plain).otherwise(_digits(hit))


def _words(text: Column) -> Column:
    """Words as patterns see them: lower case, every digit a 0."""
    return F.regexp_extract_all(F.translate(F.lower(text), "123456789", "0" * 9), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def mentions(rows: DataFrame) -> DataFrame:
    """Seeds and candidates of staged rows (_row, _found): _row, kind, seed, start,
    end, hit, inst, before and after (context)."""
    key = ["_row", "kind", "loose"]
    order = Window.partitionBy(*key).orderBy("n")
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    m = rows.select("_row", F.explode("_found").alias("m")).select("_row", "m.*").repartition("_row")
    m = (m.withColumns({"start": F.sum("gap").over(here) + F.coalesce(F.sum("len").over(past), F.lit(0)),
                        "after": F.lead("after").over(order)})
         .where("hit is not null").withColumn("end", F.col("start") + F.col("len")))
    m = m.where(F.col("loose") | _valid(F.col("kind"), F.col("hit")))
    # a candidate goes if it overlaps a seed of any kind: one that begins before its
    # end and ends after its start. Both orders run through a text once.
    seed = ~F.col("loose")
    up = Window.partitionBy("_row").orderBy("start", "loose").rowsBetween(Window.unboundedPreceding, 0)
    down = (Window.partitionBy("_row").orderBy(F.desc("start"), "loose")
            .rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumns({"_end": F.max(F.when(seed, F.col("end"))).over(up),
                       "_next": F.min(F.when(seed, F.col("start"))).over(down)})
    clear = (F.coalesce(F.col("_end") <= F.col("start"), F.lit(True))
             & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True)))
    return (m.where(seed | clear)
            .select("_row", "kind", seed.alias("seed"), "start", "end", "hit",
                    _instance(F.col("kind"), F.col("hit")).alias("inst"), "before", "after"))


# ---------------------------------------------------------------- graph
def _patterns(before: Column, after: Column) -> Column:
    """The patterns of one context; a context without words has none."""
    left, right = _words(before), _words(after)
    one, two, then = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.get(right, F.lit(0))
    return F.array_compact(F.array(F.concat(F.lit("l "), one), F.concat(F.lit("ll "), two, F.lit(" "), one),
                                   F.concat(F.lit("r "), then)))


def _places(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, places) in all texts, of the wanted patterns."""
    part = F.split("pattern", " ")
    asked = wanted.select("pattern", F.element_at(part, -1).alias("_w"),
                          F.when(F.size(part) == 3, part[1]).alias("_v")).distinct()
    pairs = asked.where("_v is not null").select("_v", "_w").distinct().withColumn("_pair", F.lit(True))
    stream = texts.select(_words(F.col("_text")).alias("_all")).where(F.size("_all") > 0)
    stream = stream.select(F.arrays_zip(F.array_prepend(F.slice("_all", 1, F.size("_all") - 1), F.lit(None)).alias("_v"),
                                        F.col("_all").alias("_w")).alias("_z"))
    # a word before is kept only where the two are asked for: as many groups as patterns
    counts = stage(stream.select(F.inline("_z")).join(asked.select("_w").distinct(), "_w", "left_semi")
                   .join(pairs, ["_v", "_w"], "left")
                   .groupBy(F.when(F.col("_pair"), F.col("_v")).alias("_v"), "_w").agg(F.count("*").alias("_n")),
                   "pii-places")
    single = asked.where("_v is null").join(counts.groupBy("_w").agg(F.sum("_n").alias("places")), "_w")
    double = asked.where("_v is not null").join(counts.withColumnRenamed("_n", "places"), ["_v", "_w"])
    return single.select("pattern", "places").unionByName(double.select("pattern", "places"))


def _confidence(trusted: Column, n: Column) -> Column:
    """Lower Wilson bound (two deviations) of the share ``trusted`` of ``n``."""
    p = trusted / n
    return (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)


def trusted_instances(found: DataFrame, texts: DataFrame, *, rounds: int = ROUNDS,
                      least_support: int = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE,
                      least_selective: float = LEAST_SELECTIVE, least_score: float = LEAST_SCORE) -> DataFrame:
    """(kind, inst, score) of the instances that are no seeds but trusted, scores
    in thousandths. ``found`` are staged mentions, ``texts`` all texts (_text)."""
    uses = found.select("kind", "inst", "seed", F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern"))
    edges = stage(uses.groupBy("kind", "pattern", "inst")
                  .agg(F.max("seed").alias("seed"), F.count("*").alias("uses")), "pii-edges")
    # only patterns that can ever have enough instances are looked up in the texts
    wanted = stage(edges.groupBy("kind", "pattern")
                   .agg(F.count("*").alias("_n"), F.sum("uses").alias("_uses"), F.max("seed").alias("_seeded"))
                   .where((F.col("_n") >= least_support) & F.col("_seeded")).select("kind", "pattern", "_uses"),
                   "pii-patterns")
    places = _places(texts, wanted)
    keep = (wanted.join(places, "pattern", "left")
            .where(F.col("_uses") >= least_selective * F.greatest(F.coalesce("places", F.lit(0)), "_uses"))
            .select("kind", "pattern"))
    edges = stage(edges.join(keep, ["kind", "pattern"])
                  .select("kind", "pattern", "inst", "seed", F.when(F.col("seed"), 1000).otherwise(0).alias("weight")),
                  "pii-graph")
    least = int(1000 * least_score)
    scores, graph = None, edges
    for r in range(rounds):
        strong = (graph.groupBy("kind", "pattern")
                  .agg((F.sum("weight") / 1000).alias("_t"), F.count("*").alias("_n"),
                       F.count_if(F.col("weight") >= least).alias("_support"))
                  .where(F.col("_support") >= least_support)
                  .withColumn("_c", _confidence(F.col("_t"), F.col("_n"))).where(F.col("_c") >= least_confidence)
                  .select("kind", "pattern", F.round(-1000 * F.log(1 - F.col("_c"))).cast("long").alias("_e")))
        new = stage(edges.where("not seed").join(strong, ["kind", "pattern"])
                    .groupBy("kind", "inst").agg(F.sum("_e").alias("_e"))
                    .select("kind", "inst", F.floor(1000 * (1 - F.exp(-F.col("_e") / 1000))).cast("int").alias("score")),
                    f"pii-scores{r}")
        same = scores is not None and new.exceptAll(scores).isEmpty() and scores.exceptAll(new).isEmpty()
        scores = new
        if same or new.isEmpty():
            break
        graph = edges.join(new, ["kind", "inst"], "left").withColumn(
            "weight", F.greatest("weight", F.coalesce("score", F.lit(0)))).drop("score")
    seeds = found.where("seed").select("kind", "inst").distinct()
    known = (found.where("not seed").select("kind", "inst").distinct().join(seeds, ["kind", "inst"], "left_semi")
             .withColumn("score", F.lit(1000)))
    return (known.unionByName(scores.where(F.col("score") >= least))
            .groupBy("kind", "inst").agg(F.max("score").alias("score")))


# ---------------------------------------------------------------- operator
def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of start, kind_no, end,
    kind, base, text, score in thousandths; by start, then kind).

    ``base`` marks what an exact form found; the others were discovered. Positions
    are code points from 0, ends exclusive. Spans of one kind and origin do not
    overlap; those of two kinds can. Null and empty texts have no spans. Repeated
    rows, and rows with a null id, give a row each. Copies of a text add mentions
    but no instances, so they teach no pattern. An empty table gives an empty
    result; other columns of ``docs`` are not read. ``limits`` go to
    ``trusted_instances``.
    """
    texts = docs.select(text_or_empty(text_col).alias("_text"))
    text = text_or_empty(text_col)
    lists = [F.coalesce(_matches(text, k, loose), F.array()) for loose in (False, True) for k in range(len(KINDS))]
    rows = stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                             F.concat(*lists).alias("_found")), "pii-matches")
    found = stage(mentions(rows), "pii-mentions")
    trusted = trusted_instances(found, texts, **limits)
    spans = (found.where("seed").withColumn("score", F.lit(1000))
             .unionByName(found.where("not seed").join(trusted, ["kind", "inst"])))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", F.col("kind").alias("kind_no"), "end", name.alias("kind"), F.col("seed").alias("base"),
                   F.col("hit").alias("text"), "score")
    lists = spans.groupBy("_row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return (rows.select("_row", "_id").join(lists, "_row", "left")
            .select(F.col("_id").alias("doc_id"), F.coalesce("spans", F.array()).alias("spans")))


# ---------------------------------------------------------------- query
def op11_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    listed = lambda spans: F.array_join(F.transform(spans, line), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


QUERIES = {"op11_pii_bootstrap": op11_pii_bootstrap}
ORACLE: dict[str, str] = {}
