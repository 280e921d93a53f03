"""Secret scans with DataFrame functions alone: base patterns and a randomness test battery.

The base finds assignments to secret-like names, access keys and long hex
runs.  The battery looks at runs of 20 and more key characters that no base
span touches.  For each, an encoding (alphabet) is inferred, and a run is a
secret if

* uniform randomness stands: chi-squared of its characters against the uniform
  alphabet, runs above and below the middle, and lag-1 serial correlation all
  have |z| <= Z_RANDOM, and
* "it is ordinary text" falls: chi-squared, runs and serial dependence have
  each a p-value under that hypothesis, combined by Fisher's method, and the
  combination passes Benjamini-Hochberg at FDR within its stratum of lengths.

Under "ordinary text", chi-squared is that of the character frequencies of
text; a change between small letters, capitals and digits follows at most
TEXT_CHANGES of the characters (names in camel case have the most), and at
least TEXT_PAIRS of the pairs of neighbouring letters are among those that are
frequent in text.  The latter two p-values are Chernoff bounds of the binomial
tails, so they are never too small.  A longer run gives all three more
evidence, so a short one needs more to be believed.

The false-discovery thresholds come from a histogram of the p-values of all
distinct candidates of the corpus (at most STRATA x BINS rows).  The normal
distribution function is approximated by a logistic one.

All work on a text of k matches is in the order of k^1.5 or less.

Defined results: a null or empty text has no spans; repeated rows have equal
spans each; other columns, whatever their names, are not looked at; offsets
are code points; base spans are all kept, spans of the battery do not overlap
them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, written

FDR = 0.01
Z_RANDOM = 3.3
#: Share of characters of text, at most, after which the class of characters changes.
TEXT_CHANGES = 0.30
#: Share of neighbouring letters of text, at least, that are a frequent pair.
TEXT_PAIRS = 0.40
#: Lower bounds of the strata of lengths.
STRATA = (20, 28, 40, 64)
BINS = 400

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = r"(?i:password|passwd|secret|token|api_?key)"
#: The look-behinds change nothing: a maximal run that is too short has no long enough part.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, first match wins: pattern, alphabet, and for text in these
#: characters the sums of squared and of cubed character probabilities.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS, 0.14, 0.024),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.20, 0.055),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.20, 0.055),
    (r"^[a-z]+$", _LOWER, 0.070, 0.0065),
    (r"^[A-Z]+$", _UPPER, 0.070, 0.0065),
    (r"^[A-Z2-7]+=*$", _UPPER + "234567", 0.070, 0.0065),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS, 0.066, 0.0060),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS, 0.066, 0.0060),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.066, 0.0060),
    (r"^[A-Za-z0-9_=-]+$", _UPPER + _LOWER + _DIGITS + "-_", 0.066, 0.0060),
    (r"", _UPPER + _LOWER + _DIGITS + "+/", 0.066, 0.0060),
)

#: Frequent pairs of letters in English, German, French and Spanish text.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro "
    "ic ne ea ra ce li ch ll be ma si om ur ei ie un di ge ue qu la el os ai"
).split()
_PAIR = "|".join(f"(?<={a})[{''.join(p[1] for p in PAIRS if p[0] == a)}]" for a in sorted({p[0] for p in PAIRS}))
_CHANGE = "(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _phi(z: Column) -> Column:
    """Standard normal distribution function, by a logistic of a cubic."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(-(F.lit(1.5976) * z + F.lit(0.070565) * z * z * z)))


def _let(value: Column, body) -> Column:
    """body(value), where the value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _before(steps: Column) -> Column:
    """The sum of all steps before each step; in blocks, so that n steps take about n^1.5 additions."""

    def blocks(s: Column, b: Column) -> Column:
        at = lambda i: F.floor(i / b).cast("int")
        sums = F.transform(F.sequence(F.lit(0), at(F.size(s) - 1)), lambda k: _total(F.slice(s, k * b + 1, b)))
        heads = lambda x: F.transform(x, lambda _, k: _total(F.slice(x, F.lit(1), k)))
        each = lambda h: F.transform(s, lambda _, i: F.element_at(h, at(i) + 1) + _total(F.slice(s, at(i) * b + 1, i % b)))
        return _let(sums, lambda x: _let(heads(x), each))

    return _let(steps, lambda s: _let(F.ceil(F.sqrt(F.size(s))).cast("int"), lambda b: blocks(s, b)))


def _located(gaps: Column, found: Column) -> Column:
    """(start, end, number) of each match, from the text between matches and the matches."""

    def places(g: Column, m: Column) -> Column:
        def place(at: Column, i: Column) -> Column:
            start = at + F.get(g, i)
            return F.struct(start.alias("start"), (start + F.get(m, i)).alias("end"), (i + 1).alias("k"))

        return F.transform(_before(F.zip_with(g, m, lambda x, y: x + y)), place)

    n = F.size(found)
    located = _let(
        F.transform(F.slice(gaps, F.lit(1), F.greatest(n, F.lit(1))), F.length),
        lambda g: _let(F.transform(found, F.length), lambda m: places(g, m)),
    )
    return F.when(n > 0, located).otherwise(F.array().cast("array<struct<start:int,end:int,k:int>>"))


def _touched(places: Column, r: Column) -> Column:
    """Whether one of the places (in order, apart from each other) overlaps r; by binary search."""
    starts_before = lambda n, step: F.coalesce(F.get(places, n + step - 1)["start"] < r["end"], F.lit(False))
    steps = F.array(*[F.lit(1 << k) for k in range(26, -1, -1)])
    n = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(starts_before(n, step), step).otherwise(0))
    return F.coalesce(F.get(places, n - 1)["end"] > r["start"], F.lit(False))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _with_matches(df: DataFrame, name: str, pattern: str, hint: Column) -> DataFrame:
    """Columns of matches and of their places; the pattern runs only where the hint holds."""
    none = F.array().cast("array<string>")
    text = F.col("text")
    df = df.withColumn(f"{name}_hit", hint)
    df = df.withColumns({
        f"{name}_text": F.when(F.col(f"{name}_hit"), _matches(text, pattern)).otherwise(none),
        f"{name}_gaps": F.when(F.col(f"{name}_hit"), F.split(text, pattern, -1)).otherwise(none),
    })
    return df.withColumn(f"{name}_at", _located(F.col(f"{name}_gaps"), F.col(f"{name}_text"))).drop(
        f"{name}_gaps", f"{name}_hit"
    )


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (array of spans by start, then kind) and the places of candidates."""
    df, text = id_and_text(docs), F.col("text")
    df = _with_matches(df, "assign", ASSIGN, text.rlike(NAMES))
    df = df.withColumn(
        "assign_value",
        F.when(F.size("assign_text") > 0, _matches(text, ASSIGN, 2)).otherwise(F.array().cast("array<string>")),
    )
    df = _with_matches(df, "access", ACCESS, text.contains("AKIA"))
    df = _with_matches(df, "hex", HEX, text.rlike(HEX))
    df = _with_matches(df, "run", CANDIDATE, text.rlike(CANDIDATE))

    long_enough = F.filter("assign_at", lambda s: F.length(F.get("assign_value", s["k"] - 1)) >= 6)
    df = df.withColumn("assign_at", F.when(F.size("assign_at") > 0, long_enough).otherwise(F.col("assign_at")))

    def spans(name: str) -> Column:
        kind = F.lit(KINDS.index(name)).alias("kind")
        return F.transform(f"{name}_at", lambda s: F.struct(s["start"].alias("start"), kind, s["end"].alias("end"))).cast(_SPAN)

    base = F.array_sort(F.concat(spans("assign"), spans("access"), spans("hex")))
    return df.select("doc_id", base.alias("base"), _free().alias("runs"))


def _free() -> Column:
    """Candidates that touch no base span: their places and texts."""

    def free(by_kind: list[Column], texts: Column) -> Column:
        apart = lambda r: ~_touched(by_kind[0], r) & ~_touched(by_kind[1], r) & ~_touched(by_kind[2], r)
        token = lambda r: F.get(texts, r["k"] - 1).alias("token")
        return F.transform(F.filter("run_at", apart), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), token(r)))

    held = F.struct(*[F.col(f"{k}_at") for k in ("assign", "access", "hex")], F.col("run_text"))
    runs = _let(held, lambda h: free([h["assign_at"], h["access_at"], h["hex_at"]], h["run_text"]))
    return F.when(F.size("run_at") > 0, runs).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def _coded(runs: Column) -> Column:
    """The candidates with the inferred encoding."""

    def encoding(token: Column) -> Column:
        out = F.lit(None).cast("int")
        for k in range(len(ENCODINGS) - 1, -1, -1):
            pattern = ENCODINGS[k][0]
            out = F.lit(k) if not pattern else F.when(token.rlike(pattern), F.lit(k)).otherwise(out)
        return out

    return F.transform(
        runs,
        lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["token"].alias("token"), encoding(r["token"]).alias("code")),
    )


def _pick(code: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), code + 1)


def _signs_of_text(token: Column) -> list[Column]:
    """Changes of class and places for them; frequent pairs of letters and all pairs of letters."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return [
        count(token, _CHANGE).alias("changes"),
        count(token, "(?<=[A-Za-z0-9])[A-Za-z0-9]").alias("places"),
        count(F.lower(token), _PAIR).alias("frequent"),
        count(token, "(?<=[A-Za-z])[A-Za-z]").alias("pairs"),
    ]


def _tail(hits: Column, n: Column, share: float, above: bool) -> Column:
    """Chernoff bound of the probability of so many hits or more (or so few or less) in n trials."""
    x = F.least(F.greatest(hits / F.greatest(n, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    part = lambda x, q: F.when(x > 0, x * F.ln(F.greatest(x, F.lit(1e-12)) / q)).otherwise(0.0)
    bound = F.exp(-n * (part(x, F.lit(share)) + part(1 - x, F.lit(1 - share))))
    far = (x > share) if above else (x < share)
    return F.when(far & (n > 0), bound).otherwise(1.0)


def _fisher(p: Column) -> Column:
    """The p-value of a product p of three independent p-values."""
    p = F.greatest(p, F.lit(1e-290))
    return F.least(F.lit(1.0), p * (1 - F.ln(p) + F.ln(p) * F.ln(p) / 2))


def _statistics(runs: Column) -> Column:
    """n, alphabet size, character codes and sum of squared character counts of each candidate."""

    def one(r: Column) -> Column:
        token, alphabet = r["token"], _pick(r["code"], [e[1] for e in ENCODINGS])
        chars = F.filter(F.split(token, ""), lambda c: c != "")
        times = F.transform(
            F.array_distinct(chars), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double")
        )
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), r["code"].alias("code"),
            F.length(token).cast("double").alias("n"),
            F.length(alphabet).cast("double").alias("m"),
            F.transform(chars, lambda c: F.instr(alphabet, c).cast("double")).alias("codes"),
            F.aggregate(times, F.lit(0.0), lambda a, x: a + x * x).alias("squares"),
            *_signs_of_text(token),
            F.xxhash64(token).alias("key"),
        )

    return F.transform(runs, one)


def _moments(runs: Column) -> Column:
    """Chi-squared, runs above and below the middle, and sums for the serial correlation."""

    def neighbours(xs: Column, f) -> Column:
        return F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), f)

    def one(r: Column) -> Column:
        n, m, codes = r["n"], r["m"], r["codes"]
        high = F.transform(codes, lambda v: (v > m / 2).cast("int"))
        total = F.aggregate(codes, F.lit(0.0), lambda a, v: a + v)
        return F.struct(
            *[r[c].alias(c) for c in ("start", "end", "code", "key", "n", "m", "changes", "places", "frequent", "pairs")],
            (m / n * r["squares"] - n).alias("chi2"),
            F.aggregate(high, F.lit(0.0), lambda a, v: a + v).alias("n_high"),
            (1 + F.aggregate(neighbours(high, lambda x, y: F.abs(x - y)), F.lit(0), lambda a, v: a + v)).cast("double").alias("n_runs"),
            total.alias("total"),
            F.aggregate(codes, F.lit(0.0), lambda a, v: a + v * v).alias("squared"),
            F.aggregate(neighbours(codes, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v).alias("lagged"),
            (F.element_at(codes, 1) + F.element_at(codes, -1)).alias("ends"),
        )

    return F.transform(runs, one)


def _verdicts(runs: Column) -> Column:
    """Whether the battery lets randomness stand, and the p-value of "ordinary text"."""

    def one(r: Column) -> Column:
        n, m = r["n"], r["m"]
        z_chi = (r["chi2"] - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        low = n - r["n_high"]
        product = 2 * r["n_high"] * low
        mean_runs = product / n + 1
        var_runs = product * (product - n) / (n * n * (n - 1))
        z_runs = F.when(var_runs > 0, (r["n_runs"] - mean_runs) / F.sqrt(F.abs(var_runs))).otherwise(F.lit(99.0))
        mean = r["total"] / n
        var = r["squared"] - n * mean * mean
        cov = r["lagged"] - mean * (2 * r["total"] - r["ends"]) + (n - 1) * mean * mean
        z_serial = F.when(var > 0, cov / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(99.0))
        s2, s3 = _pick(r["code"], [e[2] for e in ENCODINGS]), _pick(r["code"], [e[3] for e in ENCODINGS])
        mu = m + m * (n - 1) * s2 - n
        spread = 2 * n * (n - 1) * (s2 - s2 * s2) + 4 * n * (n - 1) * (n - 2) * F.greatest(s3 - s2 * s2, F.lit(1e-5))
        p_chi = _phi((r["chi2"] - mu) / (m / n * F.sqrt(spread)))
        p_runs = _tail(r["changes"], r["places"], TEXT_CHANGES, True)
        p_serial = _tail(r["frequent"], r["pairs"], TEXT_PAIRS, False)
        p_text = _fisher(p_chi * p_runs * p_serial)
        random = (F.abs(z_runs) <= Z_RANDOM) & (F.abs(z_serial) <= Z_RANDOM) & (z_chi <= Z_RANDOM) & (r["code"] > 0)
        stratum = sum(((n >= s).cast("int") for s in STRATA[1:]), F.lit(0))
        depth = F.least(F.floor(-F.log10(p_text) * 20), F.lit(BINS - 1)).cast("int")
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), random.alias("random"), stratum.alias("stratum"),
            depth.alias("depth"), r["key"].alias("key"),
        )

    return F.transform(runs, one)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and the judged candidates of every row."""
    df = base(docs)
    for step in (_coded, _statistics, _moments, _verdicts):
        df = df.withColumn("runs", step(F.col("runs")))
    return df


def thresholds(scored: DataFrame, fdr: float = FDR) -> list:
    """The least depth (-20 log10 p, floored) that Benjamini-Hochberg accepts, by stratum.

    A bin counts as its largest p-value, 10^(-depth/20); copies of a candidate are one test.
    """
    runs = scored.where(F.size("runs") > 0).select(F.explode("runs").alias("r")).select("r.stratum", "r.depth", "r.key").distinct()
    bins = runs.groupBy("stratum", "depth").agg(F.count("*").alias("n"))
    deeper = Window.partitionBy("stratum").orderBy(F.desc("depth"))
    ranked = bins.withColumns({
        "k": F.sum("n").over(deeper),
        "tests": F.sum("n").over(Window.partitionBy("stratum")),
    })
    passed = F.pow(F.lit(10.0), -F.col("depth") / 20) <= fdr * F.col("k") / F.col("tests")
    return ranked.where(passed).groupBy("stratum").agg(F.min("depth").alias("depth")).collect()


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base (array of spans) and spans (base and battery), each span (start, kind number, end)."""
    scored = written(score(docs), "secrets")
    least = {r.stratum: r.depth for r in thresholds(scored, fdr)}
    limit = F.array(*[F.lit(least.get(k, BINS)) for k in range(len(STRATA))])
    found = F.filter("runs", lambda r: r["random"] & (r["depth"] >= F.element_at(limit, r["stratum"] + 1)))
    more = F.transform(
        found, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end"))
    )
    return scored.select("doc_id", "base", F.array_sort(F.concat("base", more.cast(_SPAN))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def query(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
