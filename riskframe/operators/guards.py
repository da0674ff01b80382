"""Guard jobs over text tables (GRD group).

Checks are column expressions, so a guarded table is one scan with no shuffle
and works the same on a stream. Verdicts of a model are input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.columns import col, strip
from riskframe.functions.text import token_estimate
from riskframe.functions.verdicts import faithful_flag

# Limits, patterns, replies and reasons of the input guard.
MAX_QUERY_CHARS = 4000
INJECTION_PATTERNS = (
    r"ignore (all )?(previous|prior|above) (instructions|prompts)",
    r"disregard (all )?(previous|prior|above)",
    r"system prompt",
    r"reveal your (system )?prompt",
    r"you are now",
    r"act as (a )?(different|new)",
    r"jailbreak",
    r"developer mode",
    r"<\|.*?\|>",
)
GREETING_PATTERN = (
    r"^(hi|hello|hey|howdy|greetings?|good\s?(morning|afternoon|evening|day)|thanks?|thank\s?you|bye|goodbye|"
    r"ok|okay|sure|yes|no|please|help|what can you do|who are you|what are you)\b[\s!?.]*$"
)
DOMAIN_KEYWORDS = (
    "supply chain", "shipment", "shipping", "inventory", "warehouse", "freight", "logistics",
    "procurement", "vendor", "stockout", "lead time", "fulfilment", "fulfillment", "transit", "cargo",
    "sku", "late deliver", "late delivery", "delivery status", "delivery risk",
    "demand forecast", "order fulfil", "customs clearance", "port congestion",
    "disruption", "supplier risk", "supplier performance", "bm25", "rerank",
    "overstock", "out of stock", "safety stock", "reorder", "backorder",
    "carrier performance", "shipping mode", "shipping cost", "shipping delay",
    "supply disruption", "supplier failure", "supply chain risk",
)
GREETING_REPLY = (
    "Hello! I'm the Supply Chain Risk Intelligence Assistant. "
    "Ask me about supplier risks, shipment delays, inventory anomalies, "
    "or any supply chain disruption and I'll provide actionable insights."
)
REASONS = {
    "empty": "Empty query",
    "long": "Query exceeds 4000 characters",
    "injection": "Possible prompt injection: '{}'",
    "off_topic": "Query appears off-topic for supply-chain risk intelligence.",
    "unavailable": "Classification service unavailable — please try again.",
}

# PII patterns in the order they are applied.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b(?:\d[ -]*?){13,16}\b",
    "phone": r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)?\d{3}[\s.-]?\d{4}\b",
}

# Letters of any script are folded; digits, blanks and word edges are those of Unicode.
INJECTION_RE = "(?iU)" + "|".join(INJECTION_PATTERNS)
DOMAIN_RE = r"(?iU)\b(" + "|".join(DOMAIN_KEYWORDS) + r")\b"


# ------------------------------------------------------------------ input
def length_reason(c: Column | str) -> Column:
    """GRD1: why the length rules reject a text; null when they do not."""
    text = col(c)
    blank = text.isNull() | (strip(text) == "")
    return F.when(blank, REASONS["empty"]).when(F.length(text) > MAX_QUERY_CHARS, REASONS["long"])


def injection_match(c: Column | str) -> Column:
    """GRD2: the part of a text that looks like prompt injection; null when none does."""
    return F.when(col(c).rlike(INJECTION_RE), F.regexp_extract(col(c), INJECTION_RE, 0))


def is_greeting(c: Column | str) -> Column:
    """GRD3: the whole text is a greeting or small talk."""
    return strip(col(c)).rlike("(?iU)" + GREETING_PATTERN)


def has_domain_keyword(c: Column | str) -> Column:
    """GRD4: the text names something specific to supply chains."""
    return col(c).rlike(DOMAIN_RE)


def _verdict(ok: bool, reason: Column | str = "", severity: str = "LOW", reply: str = "") -> Column:
    return F.struct(
        F.lit(ok).alias("ok"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        F.lit(severity).alias("severity"),
        F.lit(reply).alias("fast_reply"),
    )


def validate_input(df: DataFrame, text: str = "text", verdict_col: str | None = None, skip_domain: bool = False) -> DataFrame:
    """GRD5: adds ``guard`` (ok, reason, severity, fast_reply) to each row.

    Order of precedence: empty, too long, injection, greeting, keyword,
    model verdict. A missing verdict means the classifier was not available.
    """
    c = F.col(text)
    reason = length_reason(c)
    hit = injection_match(c)
    head, tail = REASONS["injection"].split("{}")
    guard = (
        F.when(reason.isNotNull(), _verdict(False, reason, "MEDIUM"))
        .when(hit.isNotNull(), _verdict(False, F.concat(F.lit(head), hit, F.lit(tail)), "HIGH"))
        .when(is_greeting(c), _verdict(True, reply=GREETING_REPLY))
    )
    if not skip_domain:
        verdict = F.upper(strip(F.col(verdict_col))) if verdict_col else F.lit(None).cast("string")
        guard = (
            guard.when(has_domain_keyword(c), _verdict(True))
            .when(verdict.isNull(), _verdict(False, REASONS["unavailable"]))
            .when(~verdict.startswith("YES"), _verdict(False, REASONS["off_topic"]))
        )
    return df.withColumn("guard", guard.otherwise(_verdict(True)))


# ------------------------------------------------------------------ output
def contains_pii(c: Column | str, category: str) -> Column:
    return col(c).rlike("(?U)" + PII_PATTERNS[category])


def redact(c: Column | str, category: str) -> Column:
    """GRD6-GRD9: one category masked as ``[REDACTED_<CATEGORY>]``."""
    return F.regexp_replace(col(c), "(?U)" + PII_PATTERNS[category], f"[REDACTED_{category.upper()}]")


def scrub_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """GRD10: adds ``clean_text`` and ``pii_found`` (categories in order of application).

    Each category is looked for in the text already masked for the ones
    before it, so a card number is not also counted as a phone number. A
    pattern was found exactly where masking changed the text.
    """
    step, found = F.col(text), []
    staged = df
    for category in PII_PATTERNS:
        name = f"_masked_{category}"
        staged = staged.withColumn(name, redact(step, category))
        found.append(F.when(F.col(name) != step, F.lit(category)))
        step = F.col(name)
    return staged.withColumns(
        {"clean_text": step, "pii_found": F.array_compact(F.array(*found))}
    ).drop(*[f"_masked_{c}" for c in PII_PATTERNS])


def pii_profile(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """GRD11: number of texts per group and PII category."""
    # explode would infer a filter on the list and run the patterns a second time
    return (
        scrub_pii(df, text)
        .select(by, F.explode_outer("pii_found").alias("category"))
        .filter(F.col("category").isNotNull())
        .groupBy(by, "category")
        .agg(F.count(F.lit(1)).alias("texts"))
    )


def validate_output(
    df: DataFrame, answer: str = "answer", context: str = "context", verdict_col: str | None = None
) -> DataFrame:
    """GRD12: adds ``clean_text``, ``pii_found``, ``faithful`` and ``faithful_reason``."""
    no_context = strip(F.coalesce(F.col(context), F.lit(""))) == ""
    verdict = F.col(verdict_col) if verdict_col else F.lit(None).cast("string")
    return scrub_pii(df, answer).withColumns(
        {
            "faithful": F.when(no_context, F.lit(True)).otherwise(faithful_flag(verdict)),
            "faithful_reason": F.when(no_context, "no-context-skip").when(verdict.isNull(), "check-skipped"),
        }
    )


# ------------------------------------------------------------------ context budget
# Context budget in tokens, smallest part worth adding, characters per token.
MAX_CONTEXT_TOKENS, MIN_PARTIAL_TOKENS, CHARS_PER_TOKEN = 6000, 50, 4
RANKS_PER_BUCKET = 256


def pack_context(
    chunks: DataFrame, query: str = "query_id", rank: str = "rank", text: str = "text", cap: int = MAX_CONTEXT_TOKENS
) -> DataFrame:
    """GRD16: per query, the ranked chunks that fit in ``cap`` tokens, joined by blank lines.

    The first chunk that does not fit is cut to what is left, if that is more
    than 50 tokens; nothing after it is used. ``rank`` is a number, unique
    within a query.

    Chunks are summed per bucket of ranks first. Running totals of those sums
    tell which buckets begin within the budget; only their chunks are put in
    order, each bucket by itself. A query of any size is therefore never
    sorted in one task, and since every chunk counts a token, at most ``cap``
    of them are gathered. Until a chunk is taken its text is not carried.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = chunks.select(query, rank, token_estimate(body).alias("_tokens")).withColumn(
        "_bucket", F.floor(F.col(rank) / RANKS_PER_BUCKET)
    )
    earlier = Window.partitionBy(query).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        counted.groupBy(query, "_bucket")
        .agg(F.sum("_tokens").alias("_sum"))
        .select(query, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
        .filter(F.col("_before") <= cap)
    )
    inside = Window.partitionBy(query, "_bucket").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_used") - F.col("_tokens")
    # totals only grow, so the first overflowing chunk is the one that starts within the budget
    placed = counted.join(reached, [query, "_bucket"]).withColumn("_used", F.sum("_tokens").over(inside) + F.col("_before"))
    placed = placed.select(query, rank, "_tokens", "_used", (F.lit(cap) - before).alias("_left"))
    whole = F.col("_used") <= cap
    used = placed.groupBy(query).agg(F.coalesce(F.sum(F.when(whole, F.col("_tokens"))), F.lit(0)).alias("used_tokens"))
    taken = placed.filter(whole | ((F.col("_left") >= 0) & (F.col("_left") > MIN_PARTIAL_TOKENS)))
    # so far rows were a few numbers; only now the texts that were taken are fetched
    texts = chunks.select(query, rank, body.alias("_text")).join(taken.select(query, rank, "_used", "_left"), [query, rank])
    cut = F.substring(F.col("_text"), F.lit(1), (F.col("_left") * CHARS_PER_TOKEN).cast("int"))
    part = F.struct(F.col(rank).alias("_pos"), F.when(whole, F.col("_text")).otherwise(cut).alias("_part"))
    parts = texts.groupBy(query).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return used.join(parts, query, "left").select(
        query,
        F.coalesce(F.array_join(F.col("_parts._part"), "\n\n"), F.lit("")).alias("context"),
        F.coalesce(F.size("_parts"), F.lit(0)).alias("chunks"),
        "used_tokens",
    )
