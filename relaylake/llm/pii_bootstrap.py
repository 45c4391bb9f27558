"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base spans (e-mail, IP, card, phone) come from patterns and checks. They are
the seeds. A pattern is the two words to the left of a place; an instance is a
value: a base span's text, or a candidate token with ``MIN_DIGITS`` digits that
no base span touches. The pattern-instance graph is scored in rounds: a
pattern's confidence is the mean score of its distinct instances, those of
seeds being 1; a pattern counts from ``MIN_SUPPORT`` values of a score of at
least ``MIN_CONFIDENCE``, and that confidence, on, so what one round found can
bring forth the next one's patterns; an instance's score is the chance that at least one of
its patterns is right. Candidates at places that a counting pattern precedes,
and of a score of at least ``MIN_CONFIDENCE``, are new spans of kind ``id``.
Scores only rise; rounds end when no pattern is new and no confidence rises by
``STILL`` (once a pattern counts, its doubt shrinks to a fifth each round).

The graph holds distinct pairs, and each round is two aggregates combined on
the map side, so a pattern or value that stands everywhere is one row of them.
The texts are read once; spans and candidates of a document stay in its row.

The patterns below are possessive or anchored forms of the plain ones: they
find the same matches without going back, so a very long run of letters or
digits costs no more than its length.

Defined cases: a null text has no spans; rows with equal id and text get the
same spans; places are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import base_columns, let, read_table, stored

KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"  # punctuation around a token
MIN_DIGITS = 4
PIECE_CHARS = 1024
PIECE = rf"(?s).{{{PIECE_CHARS}}}+.*?(?:(?<=[\x20\x09-\x0D])(?=[A-Za-z])|\z)|.+"
STILL = 1e-6
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
SPAN = "array<struct<kind:int,s:int,e:int,v:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def luhn(digits: Column) -> Column:
    """The check sum of a card number's digits is a multiple of ten."""
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        return F.when((n - i) % 2 == 1, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check of a kind's match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


def checked(kind: str):
    return lambda span: holds(kind, span["v"])


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as spans: their places are the running lengths of what
    stands between them and of the matches before."""
    def placed(found: Column) -> Column:
        def walk(between: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

            def step(state: Column, i: Column) -> Column:
                s = state["at"] + F.length(F.get(between, i))
                e = s + F.length(F.get(found, i))
                span = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), F.get(found, i).alias("v"))
                return F.struct(e.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda x: x["out"])

        return F.when(F.size(found) == 0, no_spans()).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind, then place."""
    has = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    found = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        good = F.filter(matches(text, pattern, k), checked(kind))
        found.append(F.when(has[kind], good).otherwise(no_spans()))
    return F.concat(*found)


def candidates(text: Column, base: Column) -> Column:
    """Tokens with enough digits, without the punctuation around them, that
    no base span touches."""
    tokens = F.filter(matches(text, CANDIDATE, len(KINDS) - 1), lambda x: F.length(F.regexp_replace(x["v"], "[^0-9]", "")) >= MIN_DIGITS)

    def bare(x: Column) -> Column:
        lead = F.length(x["v"]) - F.length(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}]+", ""))
        value = F.regexp_replace(x["v"], EDGES, "")
        return F.struct(x["kind"].alias("kind"), (x["s"] + lead).alias("s"), (x["s"] + lead + F.length(value)).alias("e"), value.alias("v"))

    free = lambda x: ~F.exists(base, lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"]))
    return F.filter(F.transform(tokens, bare), free)


def words_of(text: Column) -> Column:
    """Words, lower-cased, without the punctuation around them (but ``:`` and
    ``=``, which often announce a value)."""
    tokens = F.transform(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}:=]+", ""))
    return F.filter(tokens, lambda w: w != "")


def last_two(words: Column) -> Column:
    return let(words, lambda w: F.when(F.size(w) > 2, F.slice(w, -2, 2)).otherwise(w))


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE_CHARS`` characters and more, with their
    places and the two words before them. A piece ends where a letter follows a
    blank: no match of any kind reaches over such a place, so the spans of the
    pieces are those of the text, and the work on a text of any length is that
    on pieces of bounded length (but for one without letters)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("before"),
                     F.array().cast("array<struct<at:int,before:array<string>,text:string>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        here = F.struct(state["at"].alias("at"), state["before"].alias("before"), piece.alias("text"))
        return F.struct((state["at"] + F.length(piece)).alias("at"), last_two(F.concat(state["before"], words_of(piece))).alias("before"),
                        F.concat(state["out"], F.array(here)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), start, step, lambda x: x["out"])


def piece_spans(piece: Column) -> Column:
    """Base spans and candidates of a piece, at their places in the text, with
    ``left``, the two words before each; null if there aren't two."""
    def placed(x: Column) -> Column:
        left = last_two(F.concat(piece["before"], words_of(F.substring(piece["text"], F.lit(1), x["s"]))))
        return F.struct(x["kind"].alias("kind"), (x["s"] + piece["at"]).alias("s"), (x["e"] + piece["at"]).alias("e"), x["v"].alias("v"),
                        let(left, lambda w: F.when(F.size(w) == 2, F.array_join(w, " "))).alias("left"))

    return let(base_spans(piece["text"]), lambda b: F.transform(F.concat(b, candidates(piece["text"], b)), placed))


def span_table(docs: DataFrame) -> DataFrame:
    """``doc_id, _id, _h, base`` and ``found`` (base spans and candidates with
    ``left``, the words before) of every row; written once, without texts."""
    rows = base_columns(docs)
    found = F.sort_array(F.flatten(F.transform(pieces(F.col("text")), piece_spans)))  # by kind, then place
    rows = stored(rows.select("doc_id", "_id", "_h", found.alias("found")), "spans")
    base = F.transform(F.filter("found", lambda x: x["kind"] < len(KINDS) - 1),
                       lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    low = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), x["left"].alias("left")))
    return rows.select("doc_id", "_id", "_h", base.alias("base"), low.alias("found"))


def scored_patterns(places: DataFrame, min_support: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Counting patterns (``left, confidence``) and scores of candidate values
    (``v, score``) when they no longer change. ``places``: ``left, v, seed``."""
    edges = places.where("left IS NOT NULL").groupBy("left", "v").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pii-edges")
    values = edges.groupBy("v").agg(F.max("seed").cast("double").alias("score"))
    before = None
    while True:
        patterns = stored(edges.join(values, "v", "left").groupBy("left").agg(
            F.sum(F.when(F.col("score") >= min_confidence, 1).otherwise(0)).alias("support"),
            F.avg(F.coalesce("score", F.lit(0.0))).alias("confidence"))
            .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)), "pii-patterns")
        if before is not None:
            old = before.select("left", F.col("confidence").alias("old"))
            rise = patterns.join(old, "left", "left").agg(F.max(F.col("confidence") - F.coalesce("old", F.lit(0.0)))).first()[0]
            if rise is None or rise < STILL:
                return patterns.select("left", "confidence"), values
        before = patterns
        # only values next to a counting pattern can rise; all others keep their start
        risen = (edges.join(patterns, "left").groupBy("v").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("risen")))
        start = edges.groupBy("v").agg(F.max("seed").cast("double").alias("seed"))
        values = stored(start.join(risen, "v", "left").select("v", F.greatest("seed", F.coalesce("risen", F.lit(0.0))).alias("score")), "pii-values")


def personal_data(docs: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``doc_id, base, added``: spans (kind, start, end, text) of every row."""
    rows = span_table(docs)
    places = rows.select("_id", "_h", F.explode("found").alias("x")).select("_id", "_h", "x.*")
    ids = len(KINDS) - 1
    patterns, values = scored_patterns(places.select("left", "v", (F.col("kind") < ids).cast("int").alias("seed")), min_support, min_confidence)
    new = (places.where(F.col("kind") == ids).join(patterns, "left").join(values.where(F.col("score") >= min_confidence), "v")
           .groupBy("_id", "_h").agg(F.collect_set(F.struct("s", "e", "v")).alias("new")))
    added = F.transform(F.sort_array("new"), lambda x: F.struct(F.lit(ids).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    return (rows.select("doc_id", "_id", "_h", "base").join(new, ["_id", "_h"], "left")
            .select("doc_id", "base", F.coalesce(added, no_spans()).alias("added")))


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return personal_data(read_table(spark, sf_dir, "documents")).select(
        "doc_id", number(0).alias("n_email"), number(1).alias("n_ip"), number(2).alias("n_card"), number(3).alias("n_phone"),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"))
