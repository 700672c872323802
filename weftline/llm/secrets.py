"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over characters are trained from labelled samples, one on random strings and one on
ordinary identifiers. A long unbroken run of characters is cut after its "=" (padding stays); a long piece is a secret when
its log-likelihood ratio per transition exceeds ``margin``, and otherwise those of its long words and stretches of highest
sum (widened to separators) that do. So a name or path before or after a key doesn't hide it. A run whose ratio exceeds
``margin`` as a whole is reported whole if no piece of it is. All of it is DataFrame expressions: every document is handled
in its own row, without a shuffle.

Null and empty texts have no spans. Texts of any length are scanned whole, in time that grows with their length. Overlaps:
a run that touches a pattern's span is not reported again; of spans that start together, kinds come in their listed order.
Every row is scanned by itself, so repeated rows agree, and ids don't matter. An empty table gives an empty one. Extra
columns stay; those called ``base`` or ``spans`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, table

# The patterns of the base scan, in the order in which kinds are listed. The length limits stand inside
# hex and access, where that can't move a match: a run is matched from its start or not at all.
ASSIGN = (
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

#: Candidate runs for the Markov models: unbroken but for the characters that encodings of random bytes use.
RUN_LEAST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}"
PIECE_LEAST = 8  # of a run that is random as a whole
DROP = 8.0  # a fall of the summed ratio that ends a stretch
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# Stems from which ordinary identifiers are composed for training.
STEMS = (
    "account action active address agent amount answer append archive array article balance batch before begin between "
    "block border branch bridge buffer build button bytes cache camera cancel capital carbon castle center change "
    "channel chapter charge check child class client cloud cluster collect column command common company complete "
    "concert config connect contain content context control convert copper corner count country create credit culture "
    "current customer daily data decide default delete delivery depth design detail develop device direction display "
    "document domain double driver dynamic economy editor effect element employ enable energy engine enough entity "
    "error estimate event example exchange execute export extend factor failure family feature field figure file filter "
    "final finish follow force foreign format forward frame function future garden general global government graph "
    "group growth handler header health height history holder hundred image import include income index industry "
    "information input insert inside instance integer interest internal invoice island item journal kernel kitchen "
    "label language large layer leader learn length letter level library light limit linear list local location logger "
    "machine manager manual market master matrix measure member memory message method middle minute mobile model module "
    "moment monitor morning mountain move multiple national nature network never node normal north notice number object "
    "office online operation option order organ origin output owner package page parameter parent partition party "
    "pattern people percent period person picture place player pointer policy pool position power prefix present "
    "pressure price primary print private problem process product profile program project property protocol provider "
    "public purchase quality quantity query question queue quick random range rate reader reason record region register "
    "release remote render replace report request require reserve resolve resource response result return review right "
    "river rotate route sample schedule schema school science scope screen search season second section select sender "
    "sequence series server service session setting shadow share shipment signal silver simple single size social "
    "source south space special spring stable stage standard start state station status storage store stream street "
    "string strong structure student style subject submit success summer supply support surface switch symbol system "
    "table target task teacher template tension terminal test text theory thread through ticket time title today "
    "total trace trade traffic train transaction transfer transition travel tree trigger type under unique unit update "
    "user value variable vector vendor version video view village visit volume wait wallet warehouse water weather "
    "weight window winter within without word worker world write year yellow zone "
    # other languages' common syllable shapes
    "aber auch eine einer gesellschaft geschichte heit keit lich nicht oder schaft schreiben ung verein wissenschaft "
    "avec beaucoup dans elle eaux ment mentre nous pour quelle question tion toujours vous "
    "cuando desde donde ejemplo gobierno mente nosotros para porque siempre tambien trabajo"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """(text, random boolean): n strings of each label, the same at each call; other ones from another first. Random ones are hex digests and base64 of digests
    in three alphabets; ordinary ones join two to four stems as words of names and paths are joined."""
    i, k = F.col("id"), F.array(*[F.lit(x) for x in STEMS])
    digest = F.sha2(F.concat(F.lit("weftline"), i.cast("string")), 256)
    base = F.base64(F.unhex(digest))
    noise = F.when(i % 4 == 0, F.substring(digest, 1, 40)).when(i % 4 == 1, F.upper(F.substring(digest, 1, 32))).when(i % 4 == 2, base).otherwise(F.upper(base))
    stem = lambda j: F.element_at(k, (F.pmod(F.xxhash64(i, F.lit(j)), F.lit(len(STEMS))) + 1).cast("int"))
    parts = F.slice(F.array(*[stem(j) for j in range(4)]), 1, (2 + i % 3).cast("int"))
    named = (
        F.when(i % 7 == 0, F.array_join(parts, "_"))
        .when(i % 7 == 1, F.array_join(F.transform(parts, F.initcap), ""))
        .when(i % 7 == 2, F.upper(F.array_join(parts, "_")))
        .when(i % 7 == 3, F.array_join(parts, "/"))
        .when(i % 7 == 4, F.array_join(parts, "-"))
        .when(i % 7 == 5, F.concat(F.array_join(parts, "/"), F.lit("/"), (i % 1000).cast("string")))
        .otherwise(F.array_join(parts, ""))
    )
    ids = spark.range(first, first + n)
    return ids.select(noise.alias("text"), F.lit(True).alias("random")).union(ids.select(named.alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition, as a row-major square table over ALPHABET.

    samples: (text, random). Counts are a distributed aggregate; at most 2 * len(ALPHABET) ** 2 rows reach the driver."""
    a = len(ALPHABET)
    pairs = samples.where("text is not null").select("random", F.explode(F.expr("transform(sequence(1, greatest(length(text) - 1, 1)), i -> substring(text, i, 2))")).alias("p"))
    counts = {True: [smoothing] * (a * a), False: [smoothing] * (a * a)}
    for r in pairs.where(F.length("p") == 2).groupBy("random", "p").count().collect():
        x, y = (ALPHABET.find(ch) for ch in r["p"])
        if x >= 0 and y >= 0:
            counts[r["random"]][x * a + y] += r["count"]
    log = {k: [math.log(v[x * a + y] / sum(v[x * a : x * a + a])) for x in range(a) for y in range(a)] for k, v in counts.items()}
    return [round(r - o, 5) for r, o in zip(log[True], log[False], strict=True)]


def _steps(run: Column, ratios: Column) -> Column:
    """Log-likelihood ratios of a run's transitions: at most one table look-up per character."""
    a = len(ALPHABET)
    at = F.filter(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda i: i > 0)
    return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda x, y: F.element_at(ratios, (x - 1) * a + y))


def _mean(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.size(steps)


def _llr(run: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio over a run's transitions."""
    return _mean(_steps(run, ratios))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, kind: str, element) -> Column:
    """element(at, x) of each of items, where ``at`` is the sum of x.n before it; kind: the type of an element. Elements are put
    together in blocks, as an array that grows by one element at a time would be copied for each."""
    full = lambda acc: F.size(acc["block"]) >= 256
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        one = F.array(element(acc["at"], x))
        block = F.when(full(acc), one).otherwise(F.concat(acc["block"], one))
        out = F.when(full(acc), F.concat(acc["out"], F.array(acc["block"]))).otherwise(acc["out"])
        return F.struct((acc["at"] + x["n"]).alias("at"), block.alias("block"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(items, start, step, lambda acc: F.flatten(F.concat(acc["out"], F.array(acc["block"]))))


SPANS = "array<struct<s:int,e:int>>"


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def _placed(pieces: Column) -> Column:
    """array<struct<at, piece>> of adjoining pieces."""
    items = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.length(p).alias("n")))
    return _scan(items, "struct<at:int,piece:string>", lambda at, x: F.struct(at.alias("at"), x["piece"].alias("piece")))


def _stretches(piece: Column, steps: Column, margin: float) -> Column:
    """The stretches of highest sum: each begins where the sum was last at zero and ends at its peak, before the sum falls by DROP
    or to zero. They are widened to separators; those that are long
    and random enough count, as do words between separators, joined where they overlap."""
    least = margin * (RUN_LEAST - 1)
    none = F.array().cast(SPANS)
    kept = lambda acc: F.when(acc["best"] > least, F.concat(acc["out"], F.array(_span(acc["s"], acc["e"])))).otherwise(acc["out"])
    state = lambda i, s, e, now, best, out: F.struct(i.cast("int").alias("i"), s.cast("int").alias("s"), e.cast("int").alias("e"), now.alias("now"), best.alias("best"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now, i = acc["now"] + x, acc["i"] + 1
        over, higher = (now <= 0) | (now <= acc["best"] - DROP), now > acc["best"]
        return F.when(over, state(i, i, i, F.lit(0.0), F.lit(0.0), kept(acc))).otherwise(state(i, acc["s"], F.when(higher, i + 1).otherwise(acc["e"]), now, F.greatest(now, acc["best"]), acc["out"]))

    found = F.aggregate(steps, state(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), none), step, kept)
    left = lambda x: F.length(F.regexp_extract(F.substring(piece, F.lit(1), x["s"]), "[A-Za-z0-9+]*$", 0))
    right = lambda x: F.length(F.regexp_extract(F.substring(piece, x["e"] + 1, F.length(piece)), "^[A-Za-z0-9+]*=*", 0))
    wide = F.transform(found, lambda x: _span(x["s"] - left(x), x["e"] + right(x)))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    words = F.transform(_placed(F.regexp_extract_all(piece, F.lit("[A-Za-z0-9+]+|[^A-Za-z0-9+]+"), F.lit(0))), lambda w: _span(w["at"], w["at"] + F.length(w["piece"])))
    counts = F.filter(F.concat(wide, words), lambda x: (x["e"] - x["s"] >= RUN_LEAST) & (_mean(F.slice(steps, x["s"] + 1, F.greatest(F.lit(0), x["e"] - x["s"] - 1))) > margin))
    joined = F.aggregate(
        F.array_sort(counts),
        none,
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["e"] > x["s"]), F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(_span(last(acc)["s"], F.greatest(last(acc)["e"], x["e"]))))).otherwise(F.concat(acc, F.array(x))),
    )
    return joined


def _random_parts(run: Column, ratios: Column, margin: float) -> Column:
    """Spans (from the run's start) that the models call random."""
    pieces = F.regexp_extract_all(run, F.lit("=*[^=]+=*"), F.lit(0))
    placed = _placed(pieces)

    def judged(p: Column, whole: Column) -> Column:
        size = F.length(p["piece"])
        inside = lambda steps: F.when(((size >= RUN_LEAST) | (whole & (size >= PIECE_LEAST))) & (_mean(steps) > margin), F.array(_span(F.lit(0), size))).when(size >= RUN_LEAST, _stretches(p["piece"], steps, margin)).otherwise(F.array().cast(SPANS))
        return F.transform(_let(_steps(p["piece"], ratios), inside), lambda x: _span(x["s"] + p["at"], x["e"] + p["at"]))

    def parts(whole: Column) -> Column:
        found = F.flatten(F.transform(placed, lambda p: judged(p, whole)))
        return _let(found, lambda f: F.when((F.size(f) == 0) & whole, F.array(_span(F.lit(0), F.length(run)))).otherwise(f))

    return _let(_llr(run, ratios) > margin, parts)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves give the positions as running sums of lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == 0 else 0))
    gap = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.filter(F.arrays_zip(gap.alias("gap"), F.transform(found, F.length).alias("size"), value.alias("value")), lambda x: x["size"].isNotNull())
    rows = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), (x["gap"] + x["size"]).alias("n"), x["value"].alias("value")))
    span = "struct<start:int,kind:int,end:int,value:string>"
    spans = _scan(rows, span, lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["n"]).alias("end"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{span}>"))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", margin: float = 0.5) -> DataFrame:
    """docs with ``base`` and ``spans``: array<struct<start, kind, end, value>> by start, then kind as in KINDS.

    base has what the patterns find; spans adds the runs that the Markov models call random."""
    t = F.coalesce(F.col(text), F.lit(""))
    table_of = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    base = F.array_sort(F.concat(F.filter(_matches(t, ASSIGN, 0), lambda x: F.length(x["value"]) >= ASSIGN_LEAST), _matches(t, ACCESS, 1), _matches(t, HEX, 2)))
    docs = docs.withColumn("base", base).withColumn("_runs", _matches(t, RUN, 3))
    free = F.filter(F.col("_runs"), lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    part = lambda r, x: F.struct((r["start"] + x["s"]).alias("start"), r["kind"].alias("kind"), (r["start"] + x["e"]).alias("end"), F.substring(r["value"], x["s"] + 1, x["e"] - x["s"]).alias("value"))
    random = F.flatten(F.transform(free, lambda r: F.transform(_random_parts(r["value"], table_of, margin), lambda x: part(r, x))))
    return docs.withColumn("spans", F.array_sort(F.concat(F.col("base"), random))).drop("_runs")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = scan(docs, train(labelled_samples(spark)))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans")
    )
