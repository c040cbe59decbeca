"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that holds a digit, or letters of both cases
with two or more lower-case letters that stand alone (names in camel case have hardly any; every eighth letter of a
random string does). Letters of one case alone are not judged: words run together reach the same entropy. Its
character class (hexadecimal, lower-case, mixed) sets the threshold. A window of 20 characters slides over it; the
window's character counts change by one character in and one out, and the entropy follows from them. The
candidate is a span of kind ``entropy`` when its best window reaches the threshold, unless the allow list
names it. Everything is SQL functions; nothing is shuffled.

Defined cases: null and empty texts hold no spans; the text stays as it is. Repeated rows get equal
results. Columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.spans import let, places, rewrite

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the run after AKIA, 20 characters in all
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
ALONE = r"(?<![a-z])[a-z](?![a-z])"
SHUFFLED = rf"[0-9]|{ALONE}.*{ALONE}"  # a digit, or cases that change as in no word
THRESHOLDS = {"hex": 3.0, "lower": 3.4, "mixed": 3.7}
ALLOWED = [
    r"^[0-9+/_=-]+$",  # numbers and rulers
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",  # identifiers in UUID form
    r"(?i)example|sample|placeholder|changeme|dummy|x{6,}",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$",  # words with a number behind
]


def _entropy(value: Column) -> Column:
    """Largest entropy in bits of any window of ``value``, which has at least WINDOW characters."""
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def over(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.get(codes, i - WINDOW)  # null while the first window fills
            def counted(n_in: Column, n_out: Column) -> Column:
                # one in and one out; both at once leave the sum as it is
                moved = (F.when(new == old, F.lit(0.0)).otherwise(
                    F.get(weights, n_in + 1) - F.get(weights, n_in)
                    + F.coalesce(F.get(weights, n_out - 1) - F.get(weights, n_out), F.lit(0.0))))
                return let(a["sum"] + F.coalesce(moved, F.lit(0.0)), lambda total: F.struct(
                    F.transform(a["counts"], lambda n, k: n + F.when(k == new, 1).otherwise(0)
                                - F.when(k == old, 1).otherwise(0)).alias("counts"),
                    total.alias("sum"),
                    F.when(i >= WINDOW - 1, F.greatest(a["best"], math.log2(WINDOW) - total / WINDOW))
                    .otherwise(a["best"]).alias("best")))
            return counted(F.get(a["counts"], new), F.get(a["counts"], old))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["best"])

    return let(F.transform(F.split(value, ""), F.ascii), over)


def _is_secret(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(value, F.lit(pattern))
    limit = (F.when(F.rlike(value, F.lit(r"^([0-9a-f]+|[0-9A-F]+)$")), THRESHOLDS["hex"])
             .when(F.rlike(value, F.lit("[A-Z]")) & F.rlike(value, F.lit("[a-z]")), THRESHOLDS["mixed"])
             .otherwise(THRESHOLDS["lower"]))
    scored = F.rlike(value, F.lit(SHUFFLED)) & (F.rlike(value, F.lit("[0-9]")) | F.rlike(value, F.lit("[A-Z]")))
    return F.when(~scored | allowed, False).otherwise(_entropy(value) >= limit)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array of places (start, end, value) for each of KINDS."""
    body = F.coalesce(F.col(text), F.lit(""))
    valued = F.filter(places(body, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    return docs.withColumns({
        "assign": valued,
        "access": places(body, ACCESS),
        "hex": places(body, HEX),
        "entropy": F.filter(places(body, CANDIDATE), lambda s: _is_secret(s["value"])),
    })


def report(found: DataFrame) -> DataFrame:
    """``scan``'s arrays as counts, a digest of the base spans and the list of all spans."""
    def listed(kinds: tuple[str, ...]) -> Column:
        def of(number: int, kind: str) -> Column:
            return F.transform(kind, lambda s: F.struct(
                s["start"].alias("start"), F.lit(number).alias("kind"),
                F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("label")))
        every = F.concat(*[of(n, k) for n, k in enumerate(kinds)])
        return F.array_join(F.transform(F.array_sort(every), lambda s: s["label"]), ",")
    return found.withColumns({
        "n_assign": F.size("assign").cast("long"), "n_access": F.size("access").cast("long"),
        "n_hex": F.size("hex").cast("long"), "n_entropy": F.size("entropy").cast("long"),
        "base_sha256": F.sha2(listed(KINDS[:3]), 256), "spans": listed(KINDS),
    }).drop(*KINDS)


def redact(docs: DataFrame, text: str = "text", put: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``put``; all rows and columns stay."""
    found = scan(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text")
    spans = F.concat(*[F.transform(k, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(put).alias("put"))) for k in KINDS])
    new = rewrite(F.col("text"), spans)
    return found.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


