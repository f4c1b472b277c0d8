"""Values found by a language model. The model is an injected callable; without one a repeatable stand-in answers."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.spans import page_of
from tracefold.operators.profile import Profile

ALLOWED = ["medical", "login_credentials", "financial_account", "home_address", "full_name"]
ESCALATE_BELOW = 0.72
CHEAP_CHARS, STRONG_CHARS = 8000, 12000
#: Characters that two pieces of a long text have in common.
OVERLAP = 400

# What the stand-in looks for.
HINTS = {
    "full_name": r"(?:Patient|Employee|Claimant|Customer|Contact|To|Bill to|Name)[ \t]*:[ \t]*([A-Z][A-Za-z.'-]+(?:[ \t]+[A-Z][A-Za-z.'-]+){1,3})",
    "home_address": r"(?i)(?:address|sent to)[ \t]*:?[ \t]*([^\n|]{10,90}\d{5}(?:-\d{4})?)",
    "financial_account": r"(?i)account[^0-9]{0,15}(\d{6,12})",
    "login_credentials": r"(?i)(?:username|login)[ \t]*:?[ \t]*([a-zA-Z0-9._-]{4,40})",
    "medical": r"(?i)(?:Assessment|Rx notes?)[ \t]*:?[ \t]*([^\n.]{5,80})",
}

ELEMENTS = "array<struct<category:string,value:string,passage:string,confidence:double>>"


def scope(categories: list[str] | None = None) -> list[str]:
    """L1: the categories to ask for, medical by default; others than ALLOWED are refused."""
    wanted = [c.strip() for c in categories or ["medical"] if c.strip()]
    bad = [c for c in wanted if c not in ALLOWED]
    if bad or not wanted:
        raise ValueError(f"not in scope: {bad or 'nothing asked for'}")
    return wanted


def prompt(categories: list[str]) -> str:
    """One instruction for the categories asked for."""
    return 'Find values of these kinds: %s. Answer with JSON {"elements": [{"category", "value", "passage", "confidence"}]}; values must stand in the text word by word.' % ", ".join(categories)


def candidates(documents: DataFrame, extractions: DataFrame, categories: list[str], limit: int | None = None) -> DataFrame:
    """L2: parsed documents that do not have values of all categories yet, by id."""
    done = extractions.where(F.col("category").isin(categories)).groupBy(F.col("document_id").alias("doc_id")).agg(F.count_distinct("category").alias("n")).where(F.col("n") == len(categories)).select("doc_id")
    d = documents.where("status = 'parsed'").join(done, "doc_id", "left_anti")
    return d.orderBy("doc_id").limit(limit) if limit is not None else d


def first_object(answer: str | None) -> dict | None:
    """The first JSON object of an answer, whatever follows; None if there is none."""
    at = (answer or "").find("{")
    if at < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(answer[at:])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def element(raw: dict, text: str, labels: list[str]) -> dict | None:
    """L3: one element with usual names and defaults; its value without a label and closing punctuation, None if it does not stand in the text."""
    pick = lambda *names: next((raw[n] for n in names if raw.get(n) not in (None, "")), None)
    category, value = pick("category", "type", "field", "label"), pick("value", "text_value", "extracted_value")
    if category is None or value is None:
        return None
    value = str(value).strip().rstrip(".,;:").strip()
    for w in sorted(labels, key=len, reverse=True):
        m = re.match(re.escape(w) + r"\s*[:=]\s*", value, re.IGNORECASE)
        if m:
            value = value[m.end() :].strip()
            break
    passage = str(pick("passage", "text", "snippet", "context", "source") or value)
    if not value or value.lower() in labels or value.lower() not in (text or passage).lower():
        return None
    try:
        confidence = min(1.0, max(0.0, float(pick("confidence") if pick("confidence") is not None else 0.5)))
    except (TypeError, ValueError):
        confidence = 0.5
    return {"category": str(category).strip().lower(), "value": value, "passage": passage, "confidence": confidence}


def unit(*parts: object) -> float:
    """A number in [0, 1) that depends on the parts alone, so that partitions and order do not matter."""
    return int.from_bytes(hashlib.sha256("\0".join(map(str, parts)).encode()).digest()[:7], "big") / 2**56


def stand_in(doc_id: object, text: str, categories: list[str], strong: bool = False) -> str:
    """The answer of a model that knows HINTS: the first match of each, with a confidence by hash; the strong one is surer."""
    out = []
    for c, p in HINTS.items():
        m = re.search(p, text) if c in categories else None
        if m:
            confidence = 0.55 + 0.42 * unit(doc_id, c)
            if strong:
                confidence = min(0.99, confidence + 0.15 + 0.15 * unit(doc_id, c, "strong"))
            out.append({"category": c, "value": m[1].strip(), "passage": m[0], "confidence": round(confidence, 2)})
    return json.dumps({"elements": out})


Model = Callable[[object, str, list[str]], str]


class Busy(RuntimeError):
    """Raised by a model that answers too many requests (429); ``after`` is the wait in seconds that it asks for."""

    def __init__(self, after: float | None = None):
        super().__init__("too many requests")
        self.after = after


@dataclass(frozen=True)
class Policy:
    """How often a busy model is asked again, the first wait in seconds (doubled each time), and the requests a minute that one task sends at most (0: any)."""

    retries: int = 3
    wait: float = 2.0
    per_minute: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def call(self, model: Model, *args: object) -> str:
        """The answer of ``model``; Busy once the retries are used up, any other error at once."""
        if self.per_minute:
            self.sleep(60 / self.per_minute)
        for n in range(self.retries + 1):
            try:
                return model(*args)
            except Busy as b:
                if n == self.retries:
                    raise
                self.sleep(b.after if b.after is not None else self.wait * 2**n)
        raise AssertionError


def first_at_hand(providers: dict[str, tuple[str | None, Model]]) -> tuple[str, Model | None]:
    """The first provider, in their order, that has a real key; the stand-in if none has."""
    for name, (key, model) in providers.items():
        if key and key.strip() and not key.lower().startswith(("your", "changeme", "<", "xxx")):
            return name, model
    return "stand_in", None


def pieces(text: str, chars: int, overlap: int = OVERLAP) -> list[str]:
    """``text`` in pieces of at most ``chars`` characters that overlap; an empty text is one piece."""
    return [text[i : i + chars] for i in range(0, max(1, len(text) - overlap), chars - overlap)]


def ask(docs: DataFrame, categories: list[str], model: Model | None = None, chars: int = CHEAP_CHARS, samples: int = 1, strong: bool = False, policy: Policy = Policy()) -> DataFrame:
    """``docs`` (doc_id, text) with elements, and error if a call failed. L4: several samples are united, the surest of equal values kept. L8: ``policy``. L10: a longer text is sent in overlapping pieces of at most ``chars`` characters. L11: other categories are dropped."""
    labels = Profile().label_words

    def one(i: object, text: str) -> tuple[list[dict], str | None]:
        best: dict[tuple[str, str], dict] = {}
        try:
            for part in [p for p in pieces(text, chars) for _ in range(samples)]:
                answer = policy.call(model, i, part, categories) if model else stand_in(i, part, categories, strong)
                for raw in (first_object(answer) or {}).get("elements", []):
                    e = element(raw, text, labels) if isinstance(raw, dict) else None
                    if e and e["category"] in categories:
                        k = (e["category"], e["value"].strip().lower())
                        if k not in best or e["confidence"] > best[k]["confidence"]:
                            best[k] = e
        except Exception as x:  # noqa: BLE001
            return [], f"{type(x).__name__}: {x}"[:255]
        return list(best.values()), None

    @F.pandas_udf(f"elements {ELEMENTS}, error string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(i, t or "") for i, t in zip(ids, texts)], columns=["elements", "error"])

    return docs.withColumn("_a", run.asNondeterministic()("doc_id", "text")).select(*docs.columns, "_a.*")


def tier(docs: DataFrame, categories: list[str] | None = None, cheap: Model | None = None, strong: Model | None = None, strong_at_hand: bool = True) -> DataFrame:
    """The cheap model for all documents, the strong one only for those with an unsure element. What the cheap one was sure of is kept beside the strong answer; a failed call leaves the cheap answer and its error."""
    from tracefold.runtime import materialize

    wanted = scope(categories)
    first = materialize(ask(docs.select("doc_id", "text"), wanted, cheap))
    unsure = F.exists("elements", lambda e: e["confidence"] < ESCALATE_BELOW)
    if not strong_at_hand:
        return first.withColumn("model_used", F.lit("cheap"))
    again = ask(first.where(unsure).withColumnsRenamed({"elements": "sure", "error": "first_error"}), wanted, strong, STRONG_CHARS, strong=True)
    kept = F.filter("sure", lambda e: e["confidence"] >= ESCALATE_BELOW)
    fresh = F.filter("elements", lambda e: ~F.exists(kept, lambda s: (s["category"] == e["category"]) & (F.lower(s["value"]) == F.lower(e["value"]))))
    again = again.select("doc_id", "text", F.when(F.col("error").isNotNull(), F.col("sure")).otherwise(F.concat(kept, fresh)).alias("elements"), F.coalesce("error", "first_error").alias("error"), F.lit("strong").alias("model_used"))
    return first.where(~unsure).withColumn("model_used", F.lit("cheap")).unionByName(again)


def rows(answers: DataFrame, spans: str | None = None) -> DataFrame:
    """Extraction rows of answers; the offset is that of the value's first place in the text, the page that of the offset. Values of a document that are equal but for case count once."""
    e = answers.select("*", F.explode("elements").alias("e"))
    at = F.expr("locate(e.value, text)") - 1
    e = e.withColumn("char_start", F.when(at >= 0, at)).withColumn("char_end", F.col("char_start") + F.length("e.value"))
    page = page_of(F.col(spans), F.col("char_start")) if spans else F.lit(None).cast("int")
    out = e.select(F.col("doc_id").alias("document_id"), page.alias("page_number"), "char_start", "char_end", "e.category", F.col("e.value").alias("raw_value"), F.col("e.value").alias("normalized_value"), "e.passage", "e.confidence", F.when(F.col("model_used") == "strong", "llm_strong").otherwise("llm_cheap").alias("method"), "model_used")
    return surest(out, ["document_id", "category"], F.col("normalized_value"))


def surest(elements: DataFrame, keys: list[str], value: Column, order: str = "normalized_value") -> DataFrame:
    """L4 as a DataFrame step: of values equal but for case and blanks around, the one of highest confidence."""
    w = Window.partitionBy(*keys, "_v").orderBy(F.col("confidence").desc(), order)
    return elements.withColumn("_v", F.lower(F.trim(value))).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_v", "_k")


def new_rows(found: DataFrame, extractions: DataFrame) -> DataFrame:
    """Rows that are not stored yet, so that a second run adds nothing."""
    known = extractions.select("document_id", "category", F.lower(F.trim("normalized_value")).alias("_v")).distinct()
    return found.withColumn("_v", F.lower(F.trim("normalized_value"))).join(known, ["document_id", "category", "_v"], "left_anti").drop("_v")


def cost(steps: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """``steps`` (model, tokens_in, tokens_out) with cost_usd by prices for a million tokens; 0 for a model without a price."""
    spark = steps.sparkSession
    p = spark.createDataFrame([(m, float(i), float(o)) for m, (i, o) in prices.items()], "model string, price_in double, price_out double")
    usd = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return steps.join(F.broadcast(p), "model", "left").withColumn("cost_usd", usd).drop("price_in", "price_out")
