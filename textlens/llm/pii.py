"""Personal data by candidate gradient boosting, in DataFrame functions only.

The base rules find e-mail addresses, IP addresses, card and phone numbers.
Looser generators propose further, overlapping spans: numbers that stand next
to other numbers (which the base rules read as one and drop), phone numbers
without a plus, e-mail addresses in disguise, addresses without a dot, IPv6.
Gradient-boosted trees score each proposal from its format and context.

No rule labels the proposals.  The trees are fitted on injected spans: private
values are made in each generator's form and put into the contexts in which the
base rules found one in any document, and behind fixed lead-ins; look-alikes
(order numbers, sums, times, words around an at sign) go to a place in every
document and behind neutral words.  A checksum or a dot is then evidence, not
the label: look-alikes pass by chance, and some bodies are the same in both
classes, so that only the context parts them.  A quarter of the injected spans
is set aside, and for each generator the lowest score that reaches a precision
there becomes the threshold.  Proposals above it that meet no base span are
added.

Fitting is Spark ML; the fitted trees become CASE expressions, so scoring is
a map over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_once

KINDS = ("email", "ip", "card", "phone")
#: Different injected spans fitted on, about, for each generator.
FIT_ROWS = 20_000
TREES = 20
DEPTH = 5
#: Precision that a generator's threshold reaches on the spans set aside: one of SET_ASIDE.
PRECISION = 0.9
SET_ASIDE = 4
#: Values injected into each kind of context.
SEEDS = 2048
#: The trees' sums here and in Spark ML differ by rounding.
ROUNDING = 1e-9
#: Characters of context before a span.
CONTEXT = 32

# The base rules.  Possessive quantifiers and the look-behinds leave the
# matches as they are and keep Java's matcher linear and off the stack.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to match.
_HINTS = {"email": ("@", None), "ip": (None, r"[0-9]\.[0-9]"), "card": (None, r"[0-9][0-9\x20-]{11}"), "phone": ("+", None)}

#: (kind, pattern, string that the text must hold, pattern that it must hold)
GENERATORS = (
    ("email", r"(?<![^\s<>\x22(),;:])[^\s@<>\x22(),;:]{1,64}+@[^\s@<>\x22(),;:]{3,255}+", "@", None),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+"
              r"(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+", "at", r"[(\[]at[)\]]"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])", None, r"[0-9]\.[0-9]"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])", ":", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])", None, r"[0-9]{13}"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9A-Za-z])", None, r"[0-9]{4}[\x20-][0-9]{4}"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9A-Za-z])", None, r"[0-9]{4}[\x20-][0-9]{6}"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])", "+", None),
    ("phone", r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])", None, r"[0-9]{3}[.-][0-9]{4}"),
)
#: The generators' patterns bound their matches' lengths.
SHORTEST = 5
LONGEST = {"email": 413, "ip": 39, "card": 19, "phone": 20}
#: Words of context that features count: all, and those of each kind.
CONTEXT_WORDS = "(?i)mail|contact|phone|tel|call|fax|mobile|card|visa|credit|pay|addr|server|host|ip"
KIND_WORDS = {"email": "(?i)mail|contact|address|write|login", "ip": r"(?i)addr|server|host|\bip",
              "card": "(?i)card|visa|credit|pay|paid", "phone": "(?i)phone|tel|call|fax|mobile"}
CONTEXT_FEATURES = ("context", *[f"{kind}_words" for kind in KINDS])
BODY_FEATURES = ("generator", "kind", "length", "digits", "letters", "foreign", "marks", "groups", "checksum", "parts", "first_digit",
                 "next_digit", "plus", "bracket", "dots", "dotted", "spaced", "last_group")
FEATURES = (*BODY_FEATURES, *CONTEXT_FEATURES)

# What precedes the injected spans that no document gives a context.
LEADS = {"email": ("mail me at ", "contact: ", "please write to ", "the address is ", "login with "),
         "ip": ("the server at ", "host ", "IP address: ", "reach the host on "),
         "card": ("card number ", "my visa is ", "pay with credit card "),
         "phone": ("call me on ", "phone: ", "tel ", "fax ", "my mobile is ")}
NEUTRAL = ("we met ", "on ", "there were ", "version ", "order ", "at ", "the sum of ", "see ", "")
#: Of private spans behind a fixed lead-in one in so many, of look-alikes one in so many stands behind the other class's words.
PRIVATE_NEUTRAL = 2
ALIKE_LEAD = 16

#: Values that are merged at once where an array is run through.
RUN = 128


def _merged_before(values: Column, merge, start: int) -> Column:
    """For each run of RUN values of an array the merge of all values before it."""
    at = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(RUN))
    none = F.struct(F.lit(start).alias("whole"), F.array().cast("array<int>").alias("before"))

    def add(a: Column, i: Column) -> Column:
        whole = F.aggregate(F.slice(values, i + 1, F.lit(RUN)), a["whole"], merge)
        return F.struct(whole.alias("whole"), F.concat(a["before"], F.array(a["whole"])).alias("before"))

    return F.aggregate(at, none, add, lambda a: a["before"])


def _before(values: Column, runs: Column, i: Column, merge) -> Column:
    """The merge of all values before place ``i``: that of the runs before it
    and at most RUN - 1 values, so a text's work is not quadratic in its spans."""
    return F.aggregate(F.slice(values, i - i % RUN + 1, i % RUN), F.get(runs, F.floor(i / RUN).cast("int")), merge)


def _with_spans(df: DataFrame, name: str, rules, context: int = 0) -> DataFrame:
    """Adds the column ``name``: for each rule ``(kind, pattern, hint, hint_re)``
    the array of its matches in ``text`` with their places and, if wanted, the
    characters before them.  Matches and the pieces between them are taken
    apart once per text, and only where the hints are met."""
    text = F.col("text")
    for n, (_, pattern, hint, hint_re) in enumerate(rules):
        may = F.lit(True)
        if hint is not None:
            may = may & text.contains(hint)
        if hint_re is not None:
            may = may & text.rlike(hint_re)
        df = with_once(df, _m=F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        df = with_once(df, **{f"_mp{n}": F.when(F.size("_m") > 0, F.struct(F.col("_m").alias("m"), F.split(text, pattern, -1).alias("p")))}).drop("_m")
    held = [f"_mp{n}" for n in range(len(rules))]
    df = with_once(df, _mp=F.array(*held)).drop(*held)
    earlier = lambda x, i: F.when(i > 0, F.get(x["m"], i - 1)).otherwise(F.lit(""))
    step = lambda x: lambda body, i: F.length(F.get(x["p"], i)) + F.length(earlier(x, i))
    plus = lambda a, n: a + n
    df = with_once(df, _steps=F.transform("_mp", lambda x: F.transform(x["m"], step(x))))
    df = with_once(df, _sums=F.transform("_steps", lambda v: F.when(F.size(v) > 0, _merged_before(v, plus, 0))))
    kinds = F.array(*[F.lit(kind) for kind, *_ in rules])

    def spans(x: Column, k: Column) -> Column:
        def span(body: Column, i: Column) -> Column:
            steps = F.get(F.col("_steps"), k)
            start = _before(steps, F.get(F.col("_sums"), k), i, plus) + F.get(steps, i)
            made = [F.get(kinds, k).alias("kind"), k.alias("rule"), start.alias("start"),
                    (start + F.length(body)).alias("end"), body.alias("body")]
            if context:  # matches have SHORTEST characters at least, so a few pieces hold the context
                some = F.sequence(F.greatest(i - (context // SHORTEST + 1), F.lit(0)), i)
                near = F.transform(some, lambda j: F.concat(F.right(earlier(x, j), F.lit(context)), F.right(F.get(x["p"], j), F.lit(context))))
                made.append(F.right(F.array_join(near, ""), F.lit(context)).alias("before"))
            return F.struct(*made)
        return F.coalesce(F.transform(x["m"], span), F.array())

    return with_once(df, **{name: F.transform("_mp", spans)}).drop("_mp", "_steps", "_sums")


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _ip_parts(body: Column) -> Column:
    """Whether all parts are at most 255."""
    def small(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(digits) <= 3, F.concat(F.lit("0"), digits).cast("int") <= 255).otherwise(F.lit(False))
    return F.forall(F.split(body, r"\."), small)


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        return _ip_parts(body)
    if kind == "card":
        digits = F.translate(body, " -", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base``: the valid spans of the base rules, by kind and start."""
    df = _with_spans(df, "_base", [(i, BASE[kind], *_HINTS[kind]) for i, kind in enumerate(KINDS)])
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    valid = lambda kind: lambda s: _valid(kind, s["body"])
    parts = [F.transform(F.filter(F.get("_base", F.lit(i)), valid(kind)), place) for i, kind in enumerate(KINDS)]
    return with_once(df, base=F.concat(*parts)).drop("_base")


def _context(before: Column) -> dict[str, Column]:
    """The context's features, from the characters before a span."""
    count = lambda words: F.size(F.regexp_extract_all(before, F.lit(words), F.lit(0)))
    return {"context": count(CONTEXT_WORDS), **{f"{kind}_words": count(KIND_WORDS[kind]) for kind in KINDS}}


def _format(rule: Column, kind: Column, body: Column) -> dict[str, Column]:
    """The body's features."""
    digits = _digits(body)
    groups = F.split(body, "[^0-9A-Za-z]+")
    numbers = F.regexp_extract(body, r"[0-9]+[^0-9]+([0-9])", 1)
    # an address in disguise as it is meant
    plain = F.regexp_replace(F.regexp_replace(body, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    yes = lambda c: c.cast("double")
    left = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    return {
        "generator": rule, "kind": kind, "length": F.length(body), "digits": F.length(digits),
        "letters": left("[^A-Za-z]"), "foreign": left(r"\P{L}") - left("[^A-Za-z]"),
        "marks": left("[0-9A-Za-z]"), "groups": F.size(groups),
        "checksum": yes(F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))),
        "parts": yes(F.when(body.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _ip_parts(body)).otherwise(F.lit(False))),
        "first_digit": F.when(digits == "", F.lit(-1)).otherwise(F.substring(digits, 1, 1).cast("int")),
        "next_digit": F.when(numbers == "", F.lit(-1)).otherwise(numbers.cast("int")),
        "plus": yes(body.startswith("+")), "bracket": yes(body.rlike(r"[(\[]")),
        "dots": F.length(body) - F.length(F.translate(body, ".", "")),
        "dotted": yes(plain.rlike(r"[\p{L}\p{N}]@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}[\p{L}\p{N}-]+$")),
        "spaced": yes(body.rlike(r"\.\x20")), "last_group": F.length(F.element_at(groups, -1)),
    }


def _features(s: Column) -> Column:
    """A proposal's place and features."""
    number = {**_format(s["rule"], s["kind"], s["body"]), **_context(s["before"])}
    return F.struct(s["kind"].alias("kind_id"), s["rule"].alias("generator_id"), s["start"].alias("start"), s["end"].alias("end"),
                    *[number[f].cast("double").alias(f) for f in FEATURES])


def _made(seed: Column) -> list[tuple[Column, Column]]:
    """For each generator a private value and a look-alike, drawn by ``seed``."""
    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(n))

    def pick(salt: str, *values) -> Column:
        return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), draw(salt, len(values)).cast("int"))

    def number(salt: str, n: int) -> Column:
        return F.lpad(draw(salt, 10 ** n).cast("string"), n, "0")

    def word(salt: str) -> Column:
        letters = F.translate(F.md5(F.concat(seed.cast("string"), F.lit(salt))), "0123456789", "ghijklmnop")
        return F.substring(letters, F.lit(1), (draw(salt + "n", 8) + 3).cast("int"))

    def checked(digits: Column) -> Column:
        ends = F.array(*[F.lit(str(d)) for d in range(10)])
        return F.concat(digits, F.get(F.filter(ends, lambda d: F.call_function("luhn_check", F.concat(digits, d))), F.lit(0)))

    def cut(digits: Column, *sizes: int) -> Column:
        places = [sum(sizes[:i]) + 1 for i in range(len(sizes))]
        pieces = [F.substring(digits, at, size) for at, size in zip(places, sizes)]
        joined = [F.concat(pieces[0], *[x for piece in pieces[1:] for x in (F.lit(mark), piece)]) for mark in (" ", "-")]
        return pick("mark", *joined)

    user, host, tld = pick("user", word("u"), F.concat(word("u"), F.lit("."), word("v")), F.concat(word("u"), number("u", 2))), word("h"), pick("tld", "org", "com", "de", "info")
    foreign = lambda end: F.concat(user, pick("é", "é", "ü", "ñ"), F.lit("@"), host, F.lit("."), end)
    plain = F.concat(user, F.lit("@"), host)
    at = pick("at", " [at] ", "(at)", " (at) ", "[at]")
    first = pick("issuer", "3", "4", "5", "6")
    four = lambda n: F.concat_ws(".", *[draw(f"part{i}", n).cast("string") for i in range(4)])
    mark = pick("mark", " ", "-", ".")
    line = F.concat(number("x", 3), pick("end", "-", "."), number("y", 4))
    high = lambda salt: F.concat((draw(salt, 8) + 2).cast("string"), number(salt, 2))
    low = lambda salt: F.concat(draw(salt, 2).cast("string"), number(salt, 2))
    area = lambda c: pick("area", F.concat(F.lit("("), c, F.lit(")")), c, c)
    local = lambda a, b: F.concat(area(a), mark, b, pick("end", "-", "."), number("y", 4))
    plus = lambda code: F.concat(F.lit("+"), code, mark, area(number("area", 3)), mark, line)
    return [
        (pick("form", plain, foreign(tld)),
         pick("form", plain, F.concat(number("a", 2), F.lit("@"), number("b", 3)), F.concat(user, F.lit("@"), number("b", 2)), foreign(number("b", 2)))),
        (F.concat(user, at, host, pick("dot", " [dot] ", "[dot]", "(dot)", "."), tld),
         pick("form", F.concat(host, at, user, F.lit(". "), F.initcap(word("v"))), F.concat(number("a", 1), at, number("b", 1), F.lit("."), number("c", 2)))),
        (four(256), four(1000)),
        (F.regexp_replace(F.md5(seed.cast("string")), "(.{4})(?=.)", "$1:"), F.concat_ws(":", *[number(f"part{i}", 2) for i in range(8)])),
        (checked(F.concat(first, pick("size", number("a", 14), number("a", 14), number("a", 11), number("a", 13), number("a", 17)))),
         pick("size", number("a", 16), number("a", 13), number("a", 15), number("a", 18))),
        (cut(checked(F.concat(first, number("a", 14))), 4, 4, 4, 4), cut(number("a", 16), 4, 4, 4, 4)),
        (cut(checked(F.concat(F.lit("3"), number("a", 13))), 4, 6, 5), cut(number("a", 15), 4, 6, 5)),
        (plus(pick("code", "1", "7", "33", "44", "49", "81", "351")), plus(F.concat(F.lit("0"), number("code", 2)))),
        (local(high("a"), high("b")), pick("low", local(low("a"), number("b", 3)), local(number("a", 3), low("b")))),
    ]


def _contexts(docs: DataFrame) -> DataFrame:
    """``kind, private, given, seed, n`` and the context's features: how many
    contexts of a class the documents (``given``) or the fixed lead-ins have."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rules = [(i, BASE[kind], *_HINTS[kind]) for i, kind in enumerate(KINDS)]
    found = _with_spans(text.where(F.col("text").rlike("[0-9@]")), "_base", rules, CONTEXT)
    valid = lambda kind: lambda s: _valid(kind, s["body"])
    spans = F.concat(*[F.filter(F.get("_base", F.lit(i)), valid(kind)) for i, kind in enumerate(KINDS)])
    private = (found.select(F.explode(spans).alias("s"))
               .select("s.kind", F.lit(True).alias("private"), F.xxhash64("s.body", "s.before").alias("hash"), F.col("s.before").alias("before")))
    place = with_once(text.withColumn("hash", F.xxhash64("text")), place=F.pmod("hash", F.length("text") + 1).cast("int"))
    before = F.substring(F.col("text"), F.greatest(F.col("place") - CONTEXT, F.lit(0)) + 1, F.least("place", F.lit(CONTEXT)))
    alike = place.select(F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))])).alias("kind"), F.lit(False).alias("private"), "hash", before.alias("before"))
    seeds = docs.sparkSession.range(SEEDS).select(F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))])).alias("kind"), F.col("id").alias("hash"))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64("hash", F.lit("lead")), F.lit(len(values))).cast("int"))
    lead = of(LEADS[KINDS[0]])
    for i, kind in enumerate(KINDS[1:], 1):
        lead = F.when(F.col("kind") == i, of(LEADS[kind])).otherwise(lead)
    drawn = F.xxhash64("hash", F.lit("side"))
    fixed = [seeds.select("kind", F.lit(True).alias("private"), "hash", F.when(F.pmod(drawn, F.lit(PRIVATE_NEUTRAL)) == 0, of(NEUTRAL)).otherwise(lead).alias("before")),
             seeds.select("kind", F.lit(False).alias("private"), "hash", F.when(F.pmod(drawn, F.lit(ALIKE_LEAD)) == 0, lead).otherwise(of(NEUTRAL)).alias("before"))]
    out = None
    for part, given in ((private, True), (alike, True), *[(f, False) for f in fixed]):
        part = part.select("kind", "private", F.lit(given).alias("given"), F.pmod("hash", F.lit(SEEDS)).alias("seed"),
                           *[c.cast("double").alias(f) for f, c in _context(F.col("before")).items()])
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def injected(docs: DataFrame) -> DataFrame:
    """The injected spans as ``generator_id, label, aside, weight`` and features.

    Each context of ``docs`` counts; in a generator both classes weigh the
    same, and in a class documents weigh as much as the fixed lead-ins (less if
    they give fewer contexts than those are)."""
    contexts = stored(_contexts(docs), "pii-contexts")
    seed = F.xxhash64("kind", "private", "given", "seed", *CONTEXT_FEATURES)
    held = with_once(contexts, hash=seed)
    bodies = [F.struct(F.lit(g).alias("rule"), F.lit(KINDS.index(kind)).alias("kind"), F.when(F.col("private"), good).otherwise(bad).alias("body"))
              for g, ((kind, *_), (good, bad)) in enumerate(zip(GENERATORS, _made(F.col("hash"))))]
    rows = held.select("private", "given", "hash", "n", "kind", *CONTEXT_FEATURES, F.explode(F.array(*bodies)).alias("s")).where("s.kind = kind")
    number = _format(F.col("s.rule"), F.col("s.kind"), F.col("s.body"))
    rows = stored(rows.select(F.col("s.rule").alias("generator_id"), F.col("private").cast("double").alias("label"), "given",
                              (F.pmod(F.xxhash64("hash", F.lit("aside")), F.lit(SET_ASIDE)) == 0).alias("aside"), "n",
                              *[number[f].cast("double").alias(f) for f in BODY_FEATURES], *CONTEXT_FEATURES), "pii-injected")
    # 36 totals at most
    totals = rows.groupBy("generator_id", "label", "given").agg(F.sum("n").alias("whole"))
    totals = totals.withColumn("side", F.least("whole", F.lit(SEEDS)))
    sides = totals.groupBy("generator_id", "label").agg(F.sum("side").alias("sides"))
    totals = totals.join(F.broadcast(sides), ["generator_id", "label"])
    weighed = rows.join(F.broadcast(totals), ["generator_id", "label", "given"])
    weight = F.col("n") / F.col("whole") * F.col("side") / F.col("sides") * 1000.0
    return weighed.select("generator_id", "label", "aside", weight.alias("weight"), *FEATURES)


def with_proposals(df: DataFrame) -> DataFrame:
    """Adds to a table with ``base`` the generators' spans with their features
    as ``proposals``, and as ``marks`` their places ``(start, end, at, open)``
    by start: ``at`` is the place in ``proposals``, ``open`` whether no base
    span is met."""
    rules = [(KINDS.index(kind), pattern, hint, hint_re) for kind, pattern, hint, hint_re in GENERATORS]
    df = _with_spans(df, "_all", rules, CONTEXT)
    df = with_once(df, proposals=F.transform(F.flatten("_all"), _features)).drop("_all")
    mark = lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at"))
    both = F.concat(F.transform("base", lambda b: mark(b, F.lit(-1))), F.transform("proposals", lambda c, i: mark(c, i)))
    df = with_once(df, marks=F.array_sort(both))
    # of the base spans that start earlier only the largest end counts, of those that start later the least start
    far = 2 ** 31 - 1
    larger, smaller = lambda a, x: F.greatest(a, x), lambda a, x: F.least(a, x)
    df = with_once(df, _ends=F.transform("marks", lambda m: F.when(m["at"] < 0, m["end"]).otherwise(F.lit(0))),
                   _starts=F.transform(F.reverse("marks"), lambda m: F.when(m["at"] < 0, m["start"]).otherwise(F.lit(far))))
    df = with_once(df, _ends_runs=_merged_before(F.col("_ends"), larger, 0), _starts_runs=_merged_before(F.col("_starts"), smaller, far))

    def opened(m: Column, i: Column) -> Column:
        left = _before(F.col("_ends"), F.col("_ends_runs"), i, larger)
        right = _before(F.col("_starts"), F.col("_starts_runs"), F.size("marks") - 1 - i, smaller)
        return m.withField("open", (left <= m["start"]) & (right >= m["end"]))

    marks = F.filter(F.transform("marks", opened), lambda m: m["at"] >= 0)
    return with_once(df, marks=marks).drop("_ends", "_starts", "_ends_runs", "_starts_runs")


@dataclass
class Booster:
    """Fitted trees as expressions over a proposal, and each generator's threshold."""
    trees: list
    thresholds: dict

    def probability(self, row: str = "") -> str:
        """SQL of the score of features that are columns, or fields of ``row``."""
        margin = " + ".join(f"{weight!r}D * {_tree_value(tree, row)}" for weight, tree in self.trees) or "0D"
        return f"1D / (1D + exp(-2D * ({margin})))"

    def accepted(self, p: Column) -> Column:
        ok = F.lit(False)
        for generator, least in self.thresholds.items():
            ok = ok | ((p["generator_id"] == generator) & (p["p"] >= least))
        return ok


def _tree_of(node) -> tuple | float:
    """A fitted tree's node: (feature, threshold, left, right), or a leaf's value."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree_of(node.leftChild()), _tree_of(node.rightChild())


def _tree_value(tree, row: str) -> str:
    if isinstance(tree, float):
        return f"({tree!r}D)"
    feature, at, left, right = tree
    name = f"{row}.{FEATURES[feature]}" if row else FEATURES[feature]
    return f"CASE WHEN {name} <= {at!r}D THEN {_tree_value(left, row)} ELSE {_tree_value(right, row)} END"


def fit_booster(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Booster:
    """Trees from about ``fit_rows`` injected spans a generator, thresholds
    from all that are set aside (see ``injected``)."""
    spans = stored(injected(docs), "pii-spans")
    kept = spans.where("not aside")
    share = F.lit(1.0)
    for r in kept.groupBy("generator_id").count().collect():
        share = F.when(F.col("generator_id") == r.generator_id, min(1.0, fit_rows / r["count"])).otherwise(share)
    drawn = F.pmod(F.xxhash64("weight", *FEATURES), F.lit(1_000_000)) < share * 1_000_000
    fitted = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(kept.where(drawn))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, weightCol="weight").fit(fitted.select("label", "weight", "features"))
    trees = [(float(w), _tree_of(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
    booster = Booster(trees, {})
    score = F.expr(booster.probability())
    booster.thresholds = _thresholds(spans.where("aside").select("generator_id", "label", "weight", score.alias("p")))
    return booster


def _thresholds(seen: DataFrame) -> dict[int, float]:
    """For each generator the lowest score from which on the precision is
    reached, and at which more spans are private than not; a generator that
    never reaches it adds nothing."""
    found: dict[int, float] = {}
    # scores are sums of leaves and are rounded, so a generator has a bounded number
    by_score = (seen.groupBy("generator_id", F.floor(F.col("p") * 1000).alias("p"))
                .agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("hits")))
    for r in by_score.groupBy("generator_id").agg(F.sort_array(F.collect_list(F.struct("p", "n", "hits")), False).alias("s")).collect():
        n = hits = 0
        for p, k, h in r.s:
            n, hits = n + k, hits + h
            if hits >= PRECISION * n and 2 * h > k:
                found[r.generator_id] = p / 1000 - ROUNDING
    return found


def find_private(docs: DataFrame, booster: Booster | None = None) -> DataFrame:
    """``doc_id, base, added`` of each row of ``docs(doc_id, text)``.

    ``base`` and ``added`` are arrays of (kind, start, end), kind as place in
    KINDS, code points, end exclusive, by kind and start.  Added spans meet no
    base span and, in a kind, no other added span (of those that meet, the
    longer stays, then the likelier, then the first).  Null text counts as
    empty; rows may repeat; an empty table gives no rows; other columns are
    ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    booster = fit_booster(docs) if booster is None else booster
    found = with_base_spans(docs)
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform("base", place).alias("base")
    if not booster.trees or not booster.thresholds:
        return found.select("doc_id", base, F.transform("base", place).alias("added")).withColumn("added", F.filter("added", lambda s: F.lit(False)))
    found = with_proposals(found)
    places = ", ".join(f"c.{f} AS {f}" for f in ("kind_id", "generator_id", "start", "end"))
    scored = F.expr(f"transform(proposals, c -> struct({places}, {booster.probability('c')} AS p))")
    found = with_once(found, scored=scored).drop("text", "proposals")
    # generators may propose the same span: the order of proposals tells which goes first
    likely = F.filter(F.transform("marks", lambda m: F.struct(F.get("scored", m["at"]).alias("c"), m["at"].alias("at"), m["open"].alias("open"))),
                      lambda m: m["open"] & booster.accepted(m["c"]))
    found = with_once(found, likely=F.transform(likely, lambda m: m["c"].withField("at", m["at"])))
    kinds = [f"_{kind}" for kind in KINDS]
    found = with_once(found, **{name: F.filter("likely", _of_kind(i)) for i, name in enumerate(kinds)})
    added = F.concat(*[_best_of(F.col(name), kind) for name, kind in zip(kinds, KINDS)])
    added = F.transform(added, lambda c: F.struct(c["kind_id"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", base, F.array_sort(added).alias("added"))


def _of_kind(i: int):
    return lambda c: c["kind_id"] == i


def _best_of(spans: Column, kind: str) -> Column:
    """The spans of one kind, by start, that meet none that goes before them.
    A generator's spans don't meet, so only so many neighbours can."""
    near = sum(k == kind for k, *_ in GENERATORS) * (LONGEST[kind] // SHORTEST + 1)
    key = lambda x: F.struct(x["end"] - x["start"], x["p"], -x["start"], -x["at"])

    def beaten(c: Column, i: Column) -> Column:
        first = F.greatest(i - near, F.lit(0))
        others = F.slice(spans, first + 1, i - first + near + 1)
        return F.exists(others, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (key(o) > key(c)))

    return F.filter(spans, lambda c, i: ~beaten(c, i))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the sha256 of the base spans' names and
    all spans' names, from ``find_private``'s result."""
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


def redacted(docs: DataFrame, booster: Booster | None = None) -> DataFrame:
    """``docs`` (doc_id unique) with each found span of its text replaced by
    its kind in brackets; columns stay."""
    found = find_private(docs, booster).select(F.col("doc_id").alias("_id"), F.array_sort(F.concat("base", "added")).alias("_spans"))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    in_order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        new = s["end"] > state["at"]
        out = F.when(new, F.concat(state["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate(in_order, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put,
                       lambda st: F.concat(st["out"], F.substring(F.col("text"), st["at"] + 1, F.length("text"))))
    return out.withColumn("text", F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))).drop("_id", "_spans")
