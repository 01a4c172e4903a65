"""Secret scans with DataFrame functions only: three patterns and a character Markov model.

Spans are code points, end exclusive. A pattern's matches are found by ``regexp_extract_all``
and their places by ``split`` on the same pattern: what is between matches and the matches
add up to the text. Their lengths are summed in blocks, so that a text of many matches takes
little more than linear time. The model adds spans: base spans are blanked out, and of the
runs of secret-like characters that are left, left and right of base spans too, those go in
whose log-likelihood ratio, random strings over ordinary identifiers, is above a threshold
as a whole and for each character. Both models are character bigrams, counted with a groupBy
over labelled samples; the table of ratios has 80 x 80 entries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, Java pattern, group whose length counts, least length, a cheap test.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12, ASSIGN),
    # A run that is too short fails whole, so asking for the length in the pattern finds the same runs.
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    ("hex", "(?<![0-9a-f])[0-9a-f]{16,}", 0, 16, "(?<![0-9a-f])[0-9a-f]{16}"),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
#: Characters of a run that is scored, as of the shortest value that the base kinds take.
LEAST = 12
#: Log-likelihood ratio above which a run is a secret: in all, and for each pair of characters.
TOTAL, THRESHOLD = 18.0, 0.8
#: A keyword glued to a hex or access run before it: only there base spans can overlap each other.
GLUED = r"""(?i)[0-9a-z](?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Spans whose lengths are summed together.
BLOCK = 512
#: Code point of the first character in the table of ratios, and the table's width.
LOW, SIDE = 43, 80

#: Words of the ordinary identifiers that the model learns from.
WORDS = """
    access account action active address agent alpha amount article author average balance batch begin binary block board body
    bottom branch bridge browser buffer build button cache calendar canvas capital category center chain change channel chapter
    check circle class client cloud cluster code collection color column command comment company config connect content context
    control count country create currency current customer data database date default delete delivery design detail device
    document domain driver email empty engine entry error event example export feature field figure file filter final first
    folder footer format forward frame function gallery garden general global graph group handle header heading height history
    holder image import index input instance interface internal invoice item java journal kernel label language last layer
    layout left length level library license light limit line link list local location log machine main manager market master
    member memory menu message method middle model module money month mouse name network node notice number object offer office
    option order output owner package page panel paper parent part password path pattern payment people person picture place
    plan plugin point policy position post preview price primary print private process product profile program project property
    provider public query question queue random range rating reader record region release remote report request reset resource
    response result return review right role root route rule sample scale schedule schema school scope score screen script
    search second section security select sender sequence series server service session setting shape shared signal simple size
    slot socket source space special stack standard start state status storage store stream street string style subject summary
    support switch symbol system table target task team template test text theme thread time title token tool top topic total
    track traffic transfer tree trigger type unit update upload user value vector version video view visitor volume warning
    water week weight widget width window word worker write year zone
""".split()


def labelled_samples(spark: SparkSession, n: int = 12000) -> DataFrame:
    """``n`` strings of each label (label 1: random, 0: identifiers and words) made by a rule: a bounded sample to learn from."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 512)
    coded = F.base64(F.unhex(digest))
    bare = F.regexp_replace(coded, "[^A-Za-z0-9]", "")
    made = [F.substring(digest, 1, 40), F.substring(coded, 1, 40), F.substring(bare, 1, 40), F.substring(bare, 1, 24), F.upper(F.substring(bare, 1, 32)), F.lower(F.substring(bare, 1, 32)), F.lower(F.regexp_replace(bare, "[0-9]", "")), F.regexp_replace(bare, "[0-9]", "")]
    random = ids.select(F.element_at(F.array(*made), (F.col("id") % len(made) + 1).cast("int")).alias("text"), F.lit(1).alias("label"))
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(WORDS))) + 1).cast("int"))
    four = [word(k) for k in range(4)]
    number = F.pmod(F.xxhash64(F.lit("n"), F.col("id")), F.lit(10000)).cast("string")
    letter = F.floor(F.col("id") / 14) % 26
    caps = [four[0], *map(F.initcap, four[1:])]
    styles = [
        F.concat_ws("_", *four, number), F.concat(*caps, number), F.upper(F.concat_ws("_", *four, number)), F.concat_ws("/", *four, number),
        F.concat(*caps), F.concat_ws("_", *four), F.concat(*four), F.concat(*map(F.initcap, four)), F.upper(F.concat(*four)), F.concat(four[0], F.lit("="), *caps[1:], F.lit("+"), F.lit("/"), four[0]), F.repeat(F.substring(number, 1, 1), 24), F.repeat(F.lit("="), 24),
        F.concat(F.repeat(F.char(97 + letter), 24), number), F.repeat(F.char(65 + letter), 24),
    ]
    plain = ids.select(F.element_at(F.array(*styles), (F.col("id") % len(styles) + 1).cast("int")).alias("text"), F.lit(0).alias("label"))
    return random.unionByName(plain)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, by SIDE x the first character's place after LOW + the second's.

    Counts are made in Spark; what reaches the driver is at most 2 x 66 x 66 rows. Characters
    outside the alphabet and null texts are left out; a pair never seen gets add-one counts.
    """
    chars = F.split("text", "", -1)
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    seen = samples.where("text is not null").select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()
    size = len(ALPHABET)
    counts = [[[1] * size for _ in range(size)] for _ in range(2)]
    for label, pair, n in seen:
        if len(pair) == 2 and pair[0] in ALPHABET and pair[1] in ALPHABET:
            counts[label][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += n
    log = [[[math.log(n / sum(row)) for n in row] for row in table] for table in counts]
    out = [0.0] * (SIDE * SIDE)
    for i, c in enumerate(ALPHABET):
        for j, d in enumerate(ALPHABET):
            out[SIDE * (ord(c) - LOW) + ord(d) - LOW] = log[1][i][j] - log[0][i][j]
    return out


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _pieces(text: str, pattern: str, group: int) -> str:
    """What stands between matches and the matches in turn: gap, m (null after the last one), long (of the group)."""
    q = _quoted(pattern)
    both = f"zip_with(split({text}, '{q}', -1), regexp_extract_all({text}, '{q}', 0), (gap, m) -> struct(gap as gap, m as m))"
    if not group:
        return f"transform({both}, x -> struct(x.gap as gap, x.m as m, char_length(x.m) as long))"
    return f"zip_with({both}, regexp_extract_all({text}, '{q}', {group}), (x, g) -> struct(x.gap as gap, x.m as m, char_length(g) as long))"


def _spans(pieces: str, least: int, kind: int, extra: str = "") -> Column:
    """Matches of ``least`` or more as an array of struct(start, kind, end, long), with ``extra`` fields of the piece ``x``.

    Places are sums of all lengths before. They are summed for blocks, then in each block,
    as a growing array costs its length at each step.
    """
    blocks = f"transform(sequence(0, (size({pieces}) - 1) div {BLOCK}), b -> slice({pieces}, b * {BLOCK} + 1, {BLOCK}))"
    step = "char_length(x.gap) + coalesce(char_length(x.m), 0)"
    sums = f"transform({blocks}, k -> aggregate(k, 0, (n, x) -> n + {step}))"
    offsets = f"aggregate({sums}, struct(0 as at, cast(array() as array<int>) as found), (acc, n) -> struct(acc.at + n as at, concat(acc.found, array(acc.at)) as found), acc -> acc.found)"
    ends = f"(k, o) -> aggregate(k, struct(o as at, cast(array() as array<int>) as found), (acc, x) -> struct(acc.at + {step} as at, concat(acc.found, array(acc.at + char_length(x.gap))) as found), acc -> acc.found)"
    starts = f"flatten(zip_with({blocks}, {offsets}, {ends}))"
    return F.expr(f"""
        filter(zip_with({pieces}, {starts}, (x, s) -> struct(s as start, {kind} as kind, s + char_length(x.m) as end, x.long as long{extra})),
               y -> y.long >= {least})""")


def _blanked(text: str, pieces: str, least: int) -> Column:
    """The text with blanks for the matches of ``least`` or more."""
    return F.expr(f"if({pieces} is null, {text}, array_join(transform({pieces}, x -> concat(x.gap, if(x.long >= {least}, repeat(' ', char_length(x.m)), coalesce(x.m, '')))), ''))")


NONE = "cast(array() as array<struct<start: int, kind: int, end: int, long: int>>)"
KINDS = ("assign", "access", "hex", "markov")


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], *, threshold: float = THRESHOLD, total: float = TOTAL, least: int = LEAST) -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of struct(start, kind, end, long).

    Defined results: a null text is empty and has no spans; a match of a pattern takes its
    characters even if it is too short to count; the model's spans never touch base spans;
    rows and their other columns pass through, whatever their names, repeated rows too.
    """
    names = docs.columns
    given = [f"c{i}" for i in range(len(names))]
    out = docs.toDF(*given).withColumn("_text", F.coalesce(F.col(given[names.index("text")]).cast("string"), F.lit("")))
    for k, (_, pattern, group, length, test) in enumerate(BASE):
        out = out.withColumn(f"_pieces{k}", F.when(F.col("_text").rlike(test), F.expr(_pieces("_text", pattern, group))))
        out = out.withColumn(f"_spans{k}", F.when(F.col(f"_pieces{k}").isNotNull(), _spans(f"_pieces{k}", length, k)).otherwise(F.expr(NONE)))
    out = out.withColumn("_base", F.concat(*(F.col(f"_spans{k}") for k in range(len(BASE)))))
    # What an assignment's value holds goes with it; hex and access runs outside stay the same when it is blank.
    out = out.withColumn("_left", _blanked("_text", "_pieces0", BASE[0][3]))
    for _, pattern, _, length, test in BASE[1:]:
        q = _quoted(pattern)
        blank = F.expr(f"array_join(zip_with(split(_left, '{q}', -1), regexp_extract_all(_left, '{q}', 0), (gap, m) -> concat(gap, coalesce(repeat(' ', char_length(m)), ''))), '')")
        out = out.withColumn("_left", F.when(F.col("_left").rlike(test), blank).otherwise(F.col("_left")))
    run = f"(?<![A-Za-z0-9+/_=])[A-Za-z0-9+/_=]{{{least},}}+"
    out = out.withColumn("_runs", F.when(F.col("_left").rlike(run), F.expr(_pieces("_left", run, 0))))
    out = out.withColumn("_ratios", F.when(F.col("_runs").isNotNull(), F.array(*(F.lit(round(x, 6)) for x in ratios))))
    pairs = f"zip_with(slice(k, 1, size(k) - 1), slice(k, 2, size(k) - 1), (c, d) -> element_at(_ratios, {SIDE} * (ascii(c) - {LOW}) + ascii(d) - {LOW} + 1))"
    # One element, so that the characters are split once.
    score = f"aggregate(transform(array(regexp_extract_all(x.m, '.', 0)), k -> aggregate({pairs}, 0D, (n, r) -> n + r)), 0D, (n, r) -> n + r)"
    scored = _spans("_runs", least, 3, f", {score} as score")
    found = F.when(F.col("_runs").isNotNull(), F.filter(scored, lambda y: (y["score"] > total) & (y["score"] > threshold * (y["long"] - 1))))
    out = out.withColumn("_found", F.transform(found, lambda y: F.struct(y["start"].alias("start"), y["kind"].alias("kind"), y["end"].alias("end"), y["long"].alias("long"))))
    out = out.withColumn("_found", F.when(F.col("_text").rlike(GLUED), F.expr("filter(_found, r -> not exists(_base, b -> b.start < r.end and r.start < b.end))")).otherwise(F.col("_found")))
    # A generator of one row: filters on the results stay above it, where they would otherwise multiply these expressions.
    found = F.inline(F.array(F.struct("_base", F.coalesce("_found", F.expr(NONE)).alias("_added"))))
    return out.select(*given, found).toDF(*names, "_base", "_added")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return scanned.select("doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", "_added")).alias("spans"))
