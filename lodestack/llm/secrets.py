"""Operator 3: secret scans, DataFrame and SQL functions only.

Three patterns find the base spans. Beyond them, all runs of at least 16 token characters are candidates, with or without digits or
letters. Two second-order Markov models of characters, one of random strings and one of ordinary identifiers, are compared by the
log-likelihood ratio of the run: a run is a secret if the ratio exceeds PER_CHARACTER nats a character. Each model gives a
character's class (upper, lower, digit, mark) by the two classes before it, and a letter, case folded, by the two symbols before
it; digits and marks among themselves weigh nothing. A character repeated more than twice in a row counts twice, and a UUID counts
as one mark: its form says that it is an identifier.

The models come from labelled samples: strings coded from hashes in eight forms (label 1); a list of ordinary identifiers, compounds
of them as slugs, names of constants, functions and classes, paths and dates, and the words of a bounded sample of documents outside
base spans and candidates (label 0).

Positions are counted in code points: the parts between matches (``split``) and the matches alternate, so running lengths
give every span without a UDF.

Defined results: null text is empty (no spans, hash of nothing); rows are kept as often as they occur; an empty table gives an
empty result (the models then rest on the fixed samples); other columns are ignored; a very long text, also one without a break, is
scanned whole, in time in proportion to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, texts

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs that the models judge.
RUN = r"[A-Za-z0-9+/=_-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Documents (about, by a hash of the id, or of the text without one) whose words are the sample of ordinary identifiers, and random
#: strings generated of each form.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 3000
#: Labelled samples of ordinary identifiers that hold for any corpus.
ORDINARY = """
account address administrator application argument array attribute authentication average background balance behavior boolean
branch buffer building business calculate callback capacity category certificate character checkbox children classification
collection column command comment community company component compression computer condition configuration connection constant
container content context controller convert coordinate counter country created customer database datetime default definition
delete department description destination development device dictionary directory document download duration element email
encoding endpoint environment error exception execution expression extension feature february filename filter firstname folder
format framework frequency function generator getElementById handleRequest hardware height hostname html5 http2 identifier
image1 implementation import information initialize input insert instance integer interface international javascript keyboard
language_code last_modified latitude length library license listener location longitude management maximum memory message
metadata method middleware minimum module monitor navigation network notification number object operation option organization
original output package page_2 parameter parent password_reset payment percentage performance permission phone_number pipeline
platform pointer position postgresql previous priority private process product profile project property protocol provider
public quantity query random receive record reference region register relation release remove repository request resource
response result return revision runtime sample schedule schema search section security select sequence server service session
setting sha256 signature snapshot software source statement status storage stream string structure subscription summary support
switch system table target template temporary thread threshold timestamp toString total transaction transform translation
update upload user_id utf8 validation value variable vector version video visible warning website window workflow x86_64 year
"""
#: A run is a secret if its log-likelihood ratio exceeds this many nats a character (of 16 at least).
PER_CHARACTER = 1.4
#: Compounds made of the ordinary identifiers; how often the identifiers, the compounds and a document's word count in training.
COMPOUNDS, TIMES = 6000, (30, 5, 1)
#: An identifier by its form.
UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: Symbols: 0 before the start, 1 to 26 letters, a digit, a mark. Classes: 0 before the start, upper, lower, digit, mark.
SYMBOLS, CLASSES = 29, 5


def _spans(text: Column, pattern: str, kind: int, group: Column | None, least: int) -> Column:
    """Array of (start, kind, end) of the pattern's matches; ``least`` holds for the match or for its group."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    judged = found if group is None else group
    pairs = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(judged, F.length).alias("has"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["len"]).alias("at"),
        F.when(x["has"] >= least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["len"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def base_spans(text: Column) -> Column:
    """All base spans, unsorted. Runs too short to count can't change a longer run, so two patterns carry their least length."""
    access, hexes = ACCESS[:-1] + "{16,}", HEX[:-1] + "{24,}"
    return F.concat(
        F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), LEAST["assign"])).otherwise(_none()),
        F.when(text.contains("AKIA"), _spans(text, access, 1, None, LEAST["access"])).otherwise(_none()),
        F.when(text.rlike(hexes), _spans(text, hexes, 2, None, LEAST["hex"])).otherwise(_none()),
    )


def compounds(words: list[str], n: int) -> Column:
    """Identifier made of two to four of the words, and numbers, in one of eight forms by the column id."""
    of = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1 << 20)).cast("int")
    some = F.transform(F.sequence(F.lit(1), of(0) % 3 + 2), lambda k: F.element_at(F.split(F.lit(" ".join(words)), " "), (F.pmod(F.xxhash64(k, "id"), F.lit(len(words))) + 1).cast("int")))
    number, capital = (of(5) % 10000).cast("string"), lambda a: F.array_join(F.transform(a, F.initcap), "")
    date = lambda mark: F.concat_ws(mark, (of(6) % 40 + 1990).cast("string"), F.lpad((of(7) % 12 + 1).cast("string"), 2, "0"), F.lpad((of(8) % 28 + 1).cast("string"), 2, "0"))
    sometimes = lambda text: F.when(of(9) % 2 == 0, text).otherwise(F.lit(""))
    joined = lambda mark: F.array_join(some, mark)
    forms = [
        joined("-"), joined("_"), F.concat(capital(some), sometimes(number)), F.concat(F.element_at(some, 1), capital(F.slice(some, 2, 4)), sometimes(number)),
        F.concat(F.upper(joined("_")), sometimes(F.concat(F.lit("_"), number))), F.concat_ws("/", date("/"), joined("-")), F.concat(joined("/"), sometimes(F.concat(F.lit("-"), number))), F.concat_ws("-", date("-"), joined("-")),
    ]
    return F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))


def samples(docs: DataFrame) -> DataFrame:
    """(label, word, times): random strings in eight forms; ordinary identifiers, their compounds and words of some documents."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    plain, letters = F.regexp_replace(coded, "[+/=]", ""), F.regexp_replace(coded, "[^A-Za-z]", "")
    forms = F.array(F.substring(digest, 1, 40), coded, plain, F.lower(plain), F.upper(plain), letters, F.lower(letters), F.upper(letters))
    made = spark.range(SAMPLE_STRINGS).select(F.lit(1).alias("label"), F.explode(forms).alias("word"), F.lit(1).alias("times"))
    words = ORDINARY.split()
    known = spark.range(1).select(F.lit(0).alias("label"), F.explode(F.split(F.lit(" ".join(words)), " ")).alias("word"), F.lit(TIMES[0]).alias("times"))
    joined = spark.range(COMPOUNDS).select(F.lit(0).alias("label"), compounds([w for w in words if w.isalpha() and w.islower()], COMPOUNDS).alias("word"), F.lit(TIMES[1]).alias("times"))
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = texts(docs).where(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), 1) / 2.0**63 <= share)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), "[0-9a-f]{24,}", " ")
    found = some.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9+/=_-]{4,}"), F.lit(0))).alias("word"), F.lit(TIMES[2]).alias("times"))
    return made.unionByName(known).unionByName(joined).unionByName(found.where(~F.col("word").rlike(RUN)))  # candidates have no label


def _places(run: Column) -> Column:
    """Places of a run's characters in ALPHABET, from 1."""
    return F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def _symbol(place: Column) -> Column:
    return F.when(place > 62, F.lit(28)).when(place > 52, F.lit(27)).when(place > 26, place - 26).otherwise(place)


def _class(place: Column) -> Column:
    return F.when(place > 62, F.lit(4)).when(place > 52, F.lit(3)).when(place > 26, F.lit(2)).otherwise(F.lit(1))


def train(labelled: DataFrame) -> tuple[list[float], list[float]]:
    """Log-likelihood ratios (random over ordinary): of a symbol after two symbols, and of a class after two classes, row by row.

    ``labelled``: label 1 or 0, word, and times, how often the word counts. Only counts of triples come to the driver, at most
    2 * (29 ** 3 + 5 ** 3) rows.
    """
    placed = labelled.groupBy("label", "word").agg(F.sum("times").alias("times")).withColumn("places", _places(F.col("word")))
    placed = placed.select("label", "times", F.transform("places", _symbol).alias("s"), F.transform("places", _class).alias("c"))
    before = lambda name, i, k: F.coalesce(F.get(name, i - k), F.lit(0))
    triple = lambda name, kind: F.transform(name, lambda x, i: F.struct(F.lit(kind).alias("kind"), before(name, i, 2).alias("p"), before(name, i, 1).alias("q"), x.alias("x")))
    triples = placed.select("label", "times", F.explode(F.concat(triple("s", 0), triple("c", 1))).alias("t")).groupBy("label", "t").agg(F.sum("times").alias("n"))
    found = {(r["label"], *r["t"]): float(r["n"]) for r in triples.collect()}
    symbols, classes = [0.0] * SYMBOLS**3, [0.0] * CLASSES**3
    for label, sign in ((1, 1), (0, -1)):
        n = lambda kind, p, q, x: found.get((label, kind, p, q, x), 0.0)  # noqa: B023, E731
        every = [sum(n(0, p, q, x) for p in range(SYMBOLS) for q in range(SYMBOLS)) for x in range(27)]
        for q in range(SYMBOLS):
            # After one symbol, smoothed by the letter's own share, and after two, smoothed by that.
            one = [sum(n(0, p, q, x) for p in range(SYMBOLS)) + 40 * (every[x] + 1) / (sum(every[1:]) + 26) for x in range(27)]
            one = [x / sum(one[1:]) for x in one]
            for p in range(SYMBOLS):
                two = [n(0, p, q, x) + 100 * one[x] for x in range(27)]
                for x in range(1, 27):
                    symbols[(p * SYMBOLS + q) * SYMBOLS + x] += sign * math.log(two[x] / sum(two[1:]))
        for p in range(CLASSES):
            for q in range(CLASSES):
                some = [n(1, p, q, x) + 0.5 for x in range(1, CLASSES)]
                for x in range(1, CLASSES):
                    classes[(p * CLASSES + q) * CLASSES + x] += sign * math.log(some[x - 1] / sum(some))
    return symbols, classes


def _ratio(run: Column, ratios: tuple[list[float], list[float]]) -> Column:
    symbols, classes = (F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>") for table in ratios)
    begin = F.struct(*(F.lit(0).alias(k) for k in "pqab"), F.lit(0.0).alias("sum"))

    def step(acc: Column, place: Column) -> Column:
        x, c = _symbol(place), _class(place)
        more = F.element_at(symbols, (acc["p"] * SYMBOLS + acc["q"]) * SYMBOLS + x + 1) + F.element_at(classes, (acc["a"] * CLASSES + acc["b"]) * CLASSES + c + 1)
        return F.struct(acc["q"].alias("p"), x.alias("q"), acc["b"].alias("a"), c.alias("b"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(_places(run), begin, step, lambda acc: acc["sum"])


def random_spans(text: Column, ratios: tuple[list[float], list[float]], per_character: float = PER_CHARACTER) -> Column:
    """Spans of runs that the models call random."""
    found, between = F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.split(text, RUN, -1)
    pairs = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(found)), F.length).alias("gap"), found.alias("run"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["run"])
        judged = F.regexp_replace(F.regexp_replace(x["run"], UUID, "-"), r"(.)\1{2,}", "$1$1")
        secret = _ratio(judged, ratios) > per_character * F.greatest(F.lit(16), F.length(judged))
        return F.struct(end.alias("at"), F.when(secret, F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(3).alias("kind"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(RUN), spans).otherwise(_none())


def _with_spans(docs: DataFrame, text: str, ratios: tuple[list[float], list[float]], name: str) -> DataFrame:
    """Adds array column ``name``: all spans, base and random, by start and kind; random ones only where no base span is."""
    base, more = fresh(docs, "_base"), fresh(docs, "_more")
    out = docs.withColumn(base, base_spans(F.col(text))).withColumn(more, random_spans(F.col(text), ratios))
    apart = F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn(name, F.array_sort(F.concat(base, apart))).drop(base, more)


def _digest(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = _with_spans(texts(docs), "text", train(samples(docs)), "found")
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_digest(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping spans by one); other rows and columns unchanged."""
    text, spans = fresh(docs, "_text"), fresh(docs, "_spans")
    found = _with_spans(docs.withColumn(text, F.coalesce("text", F.lit(""))), text, train(samples(docs)), spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).select(docs.columns)
