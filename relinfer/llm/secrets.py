"""Secret scans (9): strong patterns, and weak parts linked when complementary ones stand near.

Built-in functions only; every step is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relinfer.llm.spans import SPAN, by_place, find_spans, of_kind, scan, spell

KINDS = ["assign", "access", "hex", "ident", "bare", "endpoint", "named"]
ASSIGN, ACCESS, HEX, IDENT, BARE, ENDPOINT, NAMED = range(7)

# Patterns of the strong kinds and the least lengths of what they find.
KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN_PATTERN = rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_PATTERN = "AKIA[A-Z0-9]+"
# A shorter run can't match, and a run has no second match.
HEX_PATTERN = "(?<![0-9a-f])[0-9a-f]{32,}+"
MIN_VALUE, MIN_ACCESS = 8, 16

# Weak parts: identifiers, values of 40 signs or more that look like a key, endpoints, assignments whose name only
# begins or ends like that of a secret (secret_access_key, account_key), with letters and digits.
IDENT_GATE = "(?i:client|account|access|user|tenant|app)_?(?i:key_?)?(?i:id|name)"
IDENT_PATTERN = rf"""\b{IDENT_GATE}["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{4,}}+"""
# The sign of an assignment may stand right in front of a key, but not behind it: there it is padding.
BARE_PATTERN = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40,}+(?![A-Za-z0-9+/_=.-])"
ENDPOINT_PATTERN = r"""\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}+|\b(?i:host|endpoint|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}+"""
NAMED_GATE = rf"(?:{KEYWORD}[_-][A-Za-z0-9_-]++|(?i:[_-]key|(?:access|account|private|secret|shared)key))"
NAMED_PATTERN = rf"""{NAMED_GATE}["']?\x20*[:=]\x20*["']?(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{{{MIN_VALUE},}}"""
# Parts that many code points apart, or fewer, belong to one scope.
SCOPE = 240


def _gated(gate: Column, text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    found = F.when(gate, find_spans(text, F.lit(pattern), F.lit(kind), group))
    return F.coalesce(found, F.array().cast(f"array<{SPAN}>"))


def _sweep(spans: Column) -> Column:
    """For spans in order: each with the greatest end so far of identifiers, secrets and strong spans."""
    kinds = {"ids": (ACCESS, IDENT), "keys": (ASSIGN, HEX, BARE, NAMED), "strong": (ASSIGN, ACCESS, HEX)}

    def advance(state: Column, x: Column) -> Column:
        return F.struct(*(F.greatest(state[k], F.when(x["kind"].isin(*of), x["end"])).alias(k) for k, of in kinds.items()))

    def seen(state: Column, x: Column) -> Column:
        return F.struct(x.alias("span"), *(state[k].alias(k) for k in kinds))

    begin = F.struct(*(F.lit(None).cast("bigint").alias(k) for k in kinds))
    return scan(spans, begin, advance, seen, f"struct<span: {SPAN}, ids: bigint, keys: bigint, strong: bigint>")


def _mirrored(spans: Column) -> Column:
    """The spans from the end of the text, in order of that place."""
    turned = F.transform(
        spans,
        lambda s: F.struct(
            s["kind"].alias("kind"), (-s["end"]).alias("start"), (-s["start"]).alias("end"), s["value"].alias("value")
        ),
    )
    return by_place(turned)


def _near(x: Column, side: str) -> Column:
    return F.coalesce(x["span"]["start"] - x[side] <= SCOPE, F.lit(False))


def linked_parts(spans: Column) -> Column:
    """The weak spans to report: an interval join of parts in scopes, as two sweeps.

    An identifier needs a secret in its scope, a bare or named key an identifier, an endpoint both.
    Weak spans inside a strong one are left out.
    """
    def marks(swept: Column, side: str) -> Column:
        return F.transform(swept, lambda x: F.struct(
            x["span"]["kind"].alias("kind"), x["span"]["start"].alias("start"), x["span"]["end"].alias("end"),
            _near(x, "ids").alias("ids"), _near(x, "keys").alias("keys"),
            F.coalesce(x["strong"] >= x["span"]["end"], F.lit(False)).alias("inside"),
        ))

    def weak(marked: Column, turn: bool) -> Column:
        # The same order on both sides, so that they can be zipped.
        return F.array_sort(F.transform(F.filter(marked, lambda x: x["kind"] >= IDENT), lambda x: F.struct(
            (-x["end"] if turn else x["start"]).alias("start"), x["kind"].alias("kind"),
            (-x["start"] if turn else x["end"]).alias("end"), x["ids"].alias("ids"), x["keys"].alias("keys"),
            x["inside"].alias("inside"),
        )))

    ahead = weak(marks(_sweep(spans), "ahead"), False)
    behind = weak(marks(_sweep(_mirrored(spans)), "behind"), True)

    def wanted(a: Column, b: Column) -> Column:
        ids, keys = a["ids"] | b["ids"], a["keys"] | b["keys"]
        need = F.when(a["kind"] == IDENT, keys).when(a["kind"].isin(BARE, NAMED), ids).otherwise(ids & keys)
        span = F.struct(a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end"), F.lit(None).cast("string").alias("value"))
        return F.when(need & ~a["inside"] & ~b["inside"], span)

    return F.filter(F.zip_with(ahead, behind, wanted), lambda x: x.isNotNull())


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), base_sha256, spans (string) and secrets (array of spans).

    Null and empty texts have none. Equal spans of two kinds are both reported. Columns of
    these names are replaced, others carried.
    """
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets")
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"))
    gated = rows.select(
        "_row", text.rlike(KEYWORD).alias("_assign"), text.contains("AKIA").alias("_access"),
        text.rlike(HEX_PATTERN).alias("_hex"), text.rlike(IDENT_GATE).alias("_ident"),
        text.rlike(NAMED_GATE).alias("_named"),
    )
    based = gated.select(
        "*", by_place(F.concat(
            F.filter(_gated(F.col("_assign"), text, ASSIGN_PATTERN, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_VALUE),
            F.filter(_gated(F.col("_access"), text, ACCESS_PATTERN, ACCESS), lambda s: s["end"] - s["start"] >= MIN_ACCESS),
            _gated(F.col("_hex"), text, HEX_PATTERN, HEX),
        )).alias("_base"),
    )
    # Weak parts are worth a look only next to an identifier.
    idents = F.col("_access") | F.col("_ident")
    parts = based.select(
        "_row", "_base", by_place(F.concat(
            "_base",
            _gated(F.col("_ident"), text, IDENT_PATTERN, IDENT), _gated(idents, text, BARE_PATTERN, BARE),
            _gated(idents, text, ENDPOINT_PATTERN, ENDPOINT), _gated(idents & F.col("_named"), text, NAMED_PATTERN, NAMED),
        )).alias("_parts"),
    )
    weak = F.when(F.size("_parts") > F.size("_base"), linked_parts(F.col("_parts")))
    none = F.array().cast(f"array<{SPAN}>")
    linked = parts.select("_row", "_base", by_place(F.concat("_base", F.coalesce(weak, none))).alias("_all"))
    return linked.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in kept),
        of_kind(F.col("_base"), ASSIGN).alias("n_assign"), of_kind(F.col("_base"), ACCESS).alias("n_access"),
        of_kind(F.col("_base"), HEX).alias("n_hex"), F.sha2(spell(F.col("_base"), KINDS), 256).alias("base_sha256"),
        spell(F.col("_all"), KINDS).alias("spans"), F.col("_all").alias("secrets"),
    )
