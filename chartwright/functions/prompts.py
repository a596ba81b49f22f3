"""Prompt texts as one column expression each, compiled from templates, and the request rows that carry them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: {{field}}, {{field:200}} for its first 200 characters, {{field|text}} for what stands where it is null.
TOKEN = re.compile(r"\{\{(\w+)(?::(\d+))?(?:\|([^{}]*))?\}\}")

TEMPLATES = {
    "localization": """Audit how well a mobile app is localized.
Store: {{store}}, market: {{market}}
Name: {{name}}
Developer: {{developer}}
Category: {{category}}
Rating: {{rating|n/a}} of {{ratings_count|n/a}} ratings, rank {{rank|n/a}}, purchases: {{iap_present}}
Description, cut:
{{description:1500}}

0 is fully localized, 10 is not localized at all. Where the market speaks English the gap is low by nature.""",
    "clonability": """Can one developer on a small budget build an app like this in four weeks?
Title: {{title|(unknown)}}
Subtitle: {{subtitle|(none)}}
Class: {{dna_class|?}} / {{dna_subclass|?}}
Publisher: {{publisher_name|?}}
Description, cut: {{description:350|(no description)}}
Markets: {{markets}}
Best tenure: {{tenure_max}} days, best rank {{best_rank}}
Subscription: {{has_subscription}}, purchases listed: {{iap_count}}

Answer in one line, either "CLONE: idea" or "SKIP: reason".""",
    "mechanic": """Describe the core loop of the app "{{name}}" from {{n_screenshots}} screenshots.
Description, cut:
{{description:800}}

{{reviews|(no reviews)}}

Two or three sentences, only what the material shows.""",
    "thesis": """Explain this opportunity in one paragraph of at most 120 words, from the data alone.
Source app: {{source_app_id}} from {{source_market}}
Target market: {{target_market}}
Category: {{category}}
Signals:
{{signals|  (none computed)}}
Mechanic: {{mechanic|(not available)}}
Predicted economics: {{predicted|(no predictions)}}
Kill metric: {{kill}}""",
    "citation": """Estimate {{claim}} of an app with a source.
App: {{name}}
App id: {{app_id}}
Market: {{market|n/a}}

Give low, mid or high, one address that backs it and a quote of at least 20 characters from there. Without a source, decline.""",
}


def field_text(value: Column, kind: str = "") -> Column:
    """A field as a prompt shows it: lists by commas, yes or no, doubles without a trailing .0, null as null."""
    if kind.startswith("array"):
        return F.when(F.size(value) > 0, F.array_join(value, ", "))
    if kind == "boolean":
        return F.when(value, "yes").when(~value, "no")
    return F.regexp_replace(value.cast("string"), r"\.0$", "") if kind in ("double", "float") else value.cast("string")


def compiled(template: str, fields: dict[str, Column]) -> Column:
    """The template with its tokens in place, as one expression; a token that no field answers is an error. A null without a
    text of its own is empty. Fields' values are put in as they are: tokens in them stay."""
    parts, at = [], 0
    for m in TOKEN.finditer(template):
        name, first, other = m.groups()
        if name not in fields:
            raise ValueError(f"no field for {{{{{name}}}}}")
        value = fields[name].cast("string")
        value = F.substring(value, 1, int(first)) if first else value
        parts += [F.lit(template[at : m.start()]), F.coalesce(value, F.lit(other or ""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def fields_of(rows: DataFrame) -> dict[str, Column]:
    """Every column of rows as a prompt shows it."""
    return {name: field_text(F.col(name), kind) for name, kind in rows.dtypes}


def prompt_requests(rows: DataFrame, keys: list[str], kind: str, model: str, template: str | None = None, cost: Column | None = None) -> DataFrame:
    """(*keys, kind, prompt, request_hash, cost) of each row: the digest covers kind, model and prompt, so that an answer is
    known again whatever else has changed. cost: by default a token for each four characters, rounded up."""
    prompt = compiled(TEMPLATES[kind] if template is None else template, fields_of(rows))
    out = rows.select(*keys, F.lit(kind).alias("kind"), prompt.alias("prompt"), *([cost.alias("cost")] if cost is not None else []))
    if cost is None:
        out = out.withColumn("cost", F.ceil(F.length("prompt") / 4).cast("double"))
    return out.select(*keys, "kind", "prompt", F.sha2(F.concat_ws("\n", "kind", F.lit(model), "prompt"), 256).alias("request_hash"), "cost")
