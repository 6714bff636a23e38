"""Operator 9, personal data, in DataFrame functions only: base patterns, and candidates chosen by boosted trees.

Generators with high recall propose spans, which may overlap, for each kind. Features are taken from a normal form, in
which masked mail signs are undone and separators don't count, and from the words before. Boosted trees are trained on
candidates that are decided without them: positive where a valid base span of the kind is met; negative where one of
another kind is, or where the normal form is no value of the kind. What the base patterns miss although its normal form
is one is left out of training, and is what the trees then judge. A fifth of the texts teaches nothing: on it the least
score is found at which the wished precision holds, which is the kind's threshold. Candidates with equal features are one
row with counts, so that what the driver trains on is bounded by the features' grid. Those at or above the threshold,
clear of base spans, are added: masked mails, numbers with odd separators, and what a base pattern swallows
together with another number.

A match's place comes from the pieces between matches: their lengths are summed in a window over the text's matches.
Pattern parts are possessive and start only where a run starts, which finds the same matches without backtracking.

Edge cases: a null text is empty; rows of equal id and text share their spans and are returned each; a null doc_id is
kept; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import json
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import keyed

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generator: (pattern, kinds it proposes)
GENERATORS = {
    "mail": (r"(?:\G|(?<![^\s@<>(),;\[\]]))[^\s@<>(),;\[\]]++(?:@|\x20?[\[(](?i:at)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)*+", ("email",)),
    "number": (r"(?<![0-9])[+(]?[0-9](?:[\x20()./_-]{0,3}[0-9])++", ("ip", "card", "phone")),
    "phone_form": (r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", ("phone",)),
    "card_form": (r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])", ("card",)),
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "mail": r"@|[\[(](?i:at)[\])]", "number": r"[0-9]", "phone_form": r"\+[0-9]", "card_form": r"[0-9]{4}"}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|addr|host|server", "card": "card|visa|pay|credit", "phone": "tel|phone|call|mobile|fax"}
FEATURES = ("digits", "groups", "fours", "paren", "luhn", "octets", "at", "context", "glued")
ROUNDS, DEPTH, RATE, PRECISION, BIN, FOLDS = 24, 3, 0.3, 0.9, 64, 5


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubled and its digits added."""
    def add(a: Column, i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return a + x % 10 + F.floor(x / 10).cast("int")

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits).between(1, 40), total % 10 == 0).otherwise(False)


def octets(value: Column) -> Column:
    """Whether every run of digits is at most 255."""
    return ~value.rlike(r"(?<![0-9])0*(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")


def matches(documents: DataFrame) -> DataFrame:
    """d, h, source (a base kind or a generator), value, start, end, before, after of every match."""
    patterns = BASE | {g: p for g, (p, _) in GENERATORS.items()}
    text = F.col("text")
    rows = keyed(documents).where(text.rlike(r"[0-9@]|[\[(](?i:at)[\])]")).select("d", "h", "text")
    # a null array, where the text can't hold a match, is not exploded
    found = [F.when(text.rlike(NEEDS[s]), F.struct(F.lit(s).alias("source"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"), F.split(text, p, -1).alias("s"))) for s, p in patterns.items()]
    rows = rows.select("d", "h", F.explode(F.array(*found)).alias("x")).where("x is not null and size(x.m) > 0")
    pairs = F.arrays_zip(F.col("x.m").alias("m"), F.slice("x.s", F.lit(1), F.size("x.m")).alias("s"), F.slice("x.s", F.lit(2), F.size("x.m")).alias("t"))
    rows = rows.select("d", "h", F.col("x.source").alias("source"), F.posexplode(pairs).alias("i", "y"))
    rows = rows.select("d", "h", "source", "i", F.col("y.m").alias("value"), F.length("y.s").alias("gap"), F.right(F.col("y.s"), F.lit(24)).alias("before"), F.left(F.col("y.t"), F.lit(2)).alias("after"))
    rows = rows.dropDuplicates(["d", "h", "source", "i"])
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("d", "h", "source").orderBy("i"))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("gap", "i")


def valid(source: Column, value: Column) -> Column:
    n = F.length(digits_of(value))
    return (source == "email") | ((source == "ip") & octets(value)) | ((source == "card") & n.between(13, 19) & luhn(digits_of(value))) | ((source == "phone") & n.between(9, 15))


def normal(value: Column) -> Column:
    """The value with masked mail signs undone."""
    return F.regexp_replace(F.regexp_replace(value, r"\x20?[\[(](?i:at)[\])]\x20?", "@"), r"\x20?[\[(](?i:dot)[\])]\x20?", ".")


def fits(kind: Column, value: Column) -> Column:
    """Whether the normal form is a value of the kind."""
    n, digits = F.length(digits_of(value)), digits_of(value)
    mail = normal(value).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    ip = value.rlike(r"^[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}$") & octets(value)
    card = n.between(13, 19) & luhn(digits) & ~value.rlike(r"^[+(]") & ~ip
    phone = n.between(9, 15) & ~ip & ~card
    return F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)


def proposals(found: DataFrame) -> DataFrame:
    """A row for each candidate and kind that its generator proposes, with the features, and `open`: it is for the trees to judge unless it meets a base span."""
    kinds = F.create_map(*[x for g, (_, ks) in GENERATORS.items() for x in (F.lit(g), F.array(*map(F.lit, ks)))])
    rows = found.where(F.col("source").isin(*GENERATORS)).withColumn("kind", F.explode(kinds[F.col("source")]))
    v, n = F.col("value"), F.length(digits_of(F.col("value")))
    step = lambda c, *cuts: sum((c >= x).cast("int") for x in cuts)
    words = F.lower("before")
    own = F.lit(False)
    other = F.lit(False)
    for k, p in CONTEXT.items():
        own = F.when(F.col("kind") == k, words.rlike(p)).otherwise(own)
        other |= words.rlike(p)
    mail = normal(v)
    rows = rows.withColumns({
        "digits": step(n, 1, 4, 7, 9, 13, 16, 20), "groups": step(F.regexp_count(v, F.lit("[0-9]+")), 1, 2, 3, 5), "fours": v.rlike(r"^(?:[0-9]{4}[^0-9]{0,3}){3}[0-9]{1,7}$").cast("int"), "paren": v.contains("(").cast("int"),
        "luhn": luhn(digits_of(v)).cast("int"), "octets": octets(v).cast("int"), "at": F.when(mail.rlike(r"@.*\.[A-Za-z]{2,}$"), 2).otherwise(mail.contains("@").cast("int")),
        "context": F.when(own, 2).when(other, 1).otherwise(0), "glued": (F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]")).cast("int"),
    })
    # a number of a telephone's length is anything, unless it is written or announced as one
    return rows.withColumn("open", fits(F.col("kind"), v) & ((F.col("kind") != "phone") | v.startswith("+") | (F.col("context") == 2)))


def grow(rows: list[tuple], depth: int) -> list | float:
    """A tree over rows (features, gradient sum, hessian sum): [feature, cut, under, over] or a leaf's value."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, at = 1e-9 + g * g / (h + 1), None
    if depth:
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for x, a, b in rows:
                s = by.setdefault(x[f], [0.0, 0.0])
                s[0] += a
                s[1] += b
            ga = ha = 0.0
            for v in sorted(by)[:-1]:
                ga, ha = ga + by[v][0], ha + by[v][1]
                gain = ga * ga / (ha + 1) + (g - ga) ** 2 / (h - ha + 1)
                if gain > best + 1e-9:
                    best, at = gain, (f, v)
    if at is None:
        return -g / (h + 1)
    f, v = at
    return [f, v, grow([r for r in rows if r[0][f] <= v], depth - 1), grow([r for r in rows if r[0][f] > v], depth - 1)]


def value_at(tree: list | float, x: tuple) -> float:
    while isinstance(tree, list):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(counts: list[tuple[tuple, float, float]]) -> tuple[float, list]:
    """(bias, trees) on the log odds from (features, positive, negative) counts."""
    pos, neg = sum(c[1] for c in counts), sum(c[2] for c in counts)
    bias = log((pos + 0.5) / (neg + 0.5))
    score, trees = [bias] * len(counts), []
    for _ in range(ROUNDS if pos else 0):
        rows = []
        for (x, a, b), s in zip(counts, score, strict=True):
            p = 1 / (1 + exp(-max(-30.0, min(30.0, s))))
            rows.append((x, (a + b) * p - a, (a + b) * p * (1 - p)))
        tree = grow(rows, DEPTH)
        trees.append(tree)
        score = [s + RATE * value_at(tree, c[0]) for s, c in zip(score, counts, strict=True)]
    return bias, trees


def threshold(scored: list[tuple[float, float, float]]) -> float:
    """The least score at which (score, positive, negative) counts, which taught nothing, keep the wished precision; infinite where none does."""
    cut, right, wrong = float("inf"), 0.0, 0.0
    levels: dict[float, list[float]] = {}
    for s, a, b in scored:
        level = levels.setdefault(round(s, 9), [0.0, 0.0])
        level[0], level[1] = level[0] + a, level[1] + b
    for s in sorted(levels, reverse=True):
        a, b = levels[s]
        right, wrong = right + a, wrong + b
        # each score level has to be mostly right by itself too, so that a precise majority carries no bad level in
        if right < PRECISION * (right + wrong) or a < 0.5 * (a + b):
            break
        cut = s
    return cut - 1e-9


def accepted(spark: SparkSession, scores: list[tuple[str, tuple, float]]) -> DataFrame:
    """kind, features and score as a table, from one literal: as many rows as the features' grid has cells at most."""
    text = json.dumps([{"kind": k, **dict(zip(FEATURES, x, strict=True)), "score": s} for k, x, s in scores])
    form = "array<struct<kind: string, " + ", ".join(f"{f}: int" for f in FEATURES) + ", score: double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), form)))


def in_bins(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each stretch of BIN characters that a span touches: spans that overlap share one."""
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(end) - 1) / BIN))))


def find(documents: DataFrame) -> DataFrame:
    """d, h, kind, start, end, base: all spans; those with base false were added by the trees."""
    found = stored(matches(documents), "matches")
    base = found.where(F.col("source").isin(*KINDS)).where(valid(F.col("source"), F.col("value"))).select("d", "h", F.col("source").alias("kind"), "start", "end")
    base = stored(base, "base")
    offered = proposals(found)
    # how far each candidate overlaps base spans: of its own kind, and of any
    b = base.select("d", "h", F.col("kind").alias("b_kind"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    own = offered.select("d", "h", "kind", "start", "end").distinct()
    touching = in_bins(own, "start", "end").join(in_bins(b, "b_start", "b_end").hint("merge"), ["d", "h", "bin"]).where("b_start < end and start < b_end")
    touching = touching.groupBy("d", "h", "kind", "start", "end").agg(F.max((F.col("b_kind") == F.col("kind")).cast("int")).alias("own"))
    offered = stored(offered.join(touching.hint("merge"), ["d", "h", "kind", "start", "end"], "left").select("d", "h", "kind", "start", "end", "own", "open", *FEATURES), "offered")
    held = F.pmod(F.xxhash64("d", "h"), F.lit(FOLDS)) == 0
    mine, loose = F.coalesce(F.col("own") == 1, F.lit(False)), F.col("own").isNull() & F.col("open")
    sums = [F.count_if(c).alias(n) for n, c in (("p", ~held & mine), ("n", ~held & ~mine & ~loose), ("held_p", held & mine), ("held_n", held & ~mine & ~loose))]
    counts = sorted(offered.groupBy("kind", *FEATURES).agg(*sums).collect())
    scores = []
    for kind in KINDS:
        cells = [(tuple(r[f] for f in FEATURES), float(r["p"]), float(r["n"]), float(r["held_p"]), float(r["held_n"])) for r in counts if r["kind"] == kind]
        bias, trees = boost([c[:3] for c in cells if c[1] + c[2]])
        total = [bias + RATE * sum(value_at(t, c[0]) for t in trees) for c in cells]
        cut = threshold([(s, a, b) for s, (_, _, _, a, b) in zip(total, cells, strict=True) if a + b])
        scores += [(kind, c[0], s - cut) for s, c in zip(total, cells, strict=True) if s >= cut]
    # candidates with equal features score alike, so the trees are applied to each cell of the grid once
    chosen = offered.where(F.col("own").isNull() & F.col("open")).join(F.broadcast(accepted(documents.sparkSession, scores)), ["kind", *FEATURES])
    # of accepted candidates that overlap, the one with the highest score stays, then the longest, then the first
    rank = F.struct(F.col("score"), (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), F.col("kind").alias("k"))
    chosen = stored(chosen.groupBy("d", "h", "kind", "start", "end").agg(F.max(rank).alias("rank")), "chosen")
    o = chosen.select("d", "h", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("rank").alias("o_rank"))
    beaten = in_bins(chosen, "start", "end").join(in_bins(o, "o_start", "o_end").hint("merge"), ["d", "h", "bin"]).where("o_start < end and start < o_end and o_rank > rank").select("d", "h", "kind", "start", "end").distinct()
    added = chosen.join(beaten.hint("merge"), ["d", "h", "kind", "start", "end"], "left_anti").select("d", "h", "kind", "start", "end")
    return stored(base.withColumn("base", F.lit(True)).union(added.withColumn("base", F.lit(False))), "spans")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_lists(documents: DataFrame) -> DataFrame:
    """d, h, found: an array of (place of the kind, start, end, kind, base) for each text that has spans."""
    place = sum(F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS))
    spans = find(documents)
    return stored(spans.groupBy("d", "h").agg(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base")).alias("found")), "lists")


def with_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text, found for each row."""
    lists = span_lists(documents)
    rows = keyed(documents).join(lists.hint("merge"), ["d", "h"], "left")  # lists grow with the corpus: no broadcast
    return rows.select("doc_id", "text", F.coalesce("found", F.expr("array()").cast(lists.schema["found"].dataType)).alias("found"))


def redacted(text: Column, found: Column) -> Column:
    """The text with a mark in each span's place; of spans that overlap, the ones that begin later are covered too."""
    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    def add(a: Column, s: Column) -> Column:
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).cast("long").alias("at"), out.alias("out"))

    done = F.aggregate(by_start, start, add)
    return F.when(F.size(found) > 0, F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(text)
