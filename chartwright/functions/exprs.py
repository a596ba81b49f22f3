"""Column expressions: banded scores, clamps, language, dates, digests, text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartwright.functions import fixed

DAY_MS = 86_400_000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def finite(x: Column) -> Column:
    """Null for NaN and the infinities: missing, never zero."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def improvement_score(d: Column) -> Column:
    """Rank improvement to 0..10 in bands; a flat rank scores 2."""
    d = d.cast("double")
    return (
        F.when(d >= 50, 8 + F.least(d - 50, F.lit(50.0)) / 50 * 2)
        .when(d >= 20, 5 + (d - 20) / 29 * 2)
        .when(d >= 0, 2 + d / 19 * 2)
        .otherwise(F.greatest(F.lit(0.0), 1 - F.least(-d, F.lit(50.0)) / 50))
    )


def ratio_score(r: Column) -> Column:
    """Lifetime value over cost to 0..10, null for null; the gaps between bands are meant."""
    return F.when(r < 5, r / 5).when(r < 10, 2 + (r - 5) / 5 * 2).when(r <= 15, 5 + (r - 10) / 5 * 2).when(r > 15, 8 + F.least(r - 15, F.lit(10.0)) / 10 * 2)


def revenue_proxy(rating: Column, count: Column, weight: Column) -> Column:
    """Rating x count x market weight to 0..10 on a log scale from 2 to 8; 0 if one is missing, not finite or not positive."""
    x = finite(finite(rating.cast("double")) * finite(count.cast("double")) * finite(weight.cast("double")))
    return F.when(x > 0, clamp((F.log10(x + 1) - 2) / 6 * 10, 0, 10)).otherwise(0.0)


def lookup(table: dict, key: Column) -> Column:
    """A value of a small fixed table by a key in lower case; null for any other key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(key))


def market_weight(market: Column, preset: str = "subscription") -> Column:
    return F.coalesce(lookup(fixed.MARKET_WEIGHTS[preset], market), F.lit(fixed.OTHER_WEIGHT[preset]))


def clonability_tier(dna_class: Column, auto: tuple[str, ...] = fixed.AUTO_CLASSES, review: tuple[str, ...] = fixed.REVIEW_CLASSES) -> Column:
    return F.when(dna_class.isin(*auto), "AUTO").when(dna_class.isin(*review), "REVIEW").otherwise("NOT")


def shortlist_parts(tenure: Column, markets: Column, total_markets: int, recent: Column, rank: Column, apps: Column) -> dict[str, Column]:
    return {
        "tenure": F.least(F.lit(1.0), tenure / 365) * 0.30,
        "spread": F.least(F.lit(1.0), markets / max(total_markets, 1)) * 0.20,
        "recent": F.least(F.lit(1.0), recent / 30) * 0.20,
        "rank": F.greatest(F.lit(0.0), 1 - rank / 100) * 0.15,
        "focus": F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), apps - 1) / 5) * 0.15,
    }


def top3_mean(signals: list[Column]) -> Column:
    """Mean of the three largest signals that are there; null when fewer are. Zeros count."""
    there = F.filter(F.array(*[finite(s.cast("double")) for s in signals]), lambda x: x.isNotNull())
    return F.when(F.size(there) >= 3, F.aggregate(F.slice(F.sort_array(there, asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x) / 3)


def paywall_score(text: Column, has_iap: Column) -> Column:
    """3 with purchases in the app, 2 more each for a subscription, a trial, a lifetime price, 1 for two tiers named."""
    t = F.lower(F.coalesce(text, F.lit("")))
    said = [F.when(t.rlike(p), 2).otherwise(0) for p in (fixed.SUBSCRIPTION, fixed.TRIAL, fixed.LIFETIME)]
    tiers = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(fixed.TIER), F.lit(1))))
    total = sum(said, F.lit(3)) + F.when(tiers >= 2, 1).otherwise(0)
    return F.when(has_iap, clamp(total, 0, 10)).otherwise(0.0)


def _once(value: Column, use) -> Column:
    """use(value) with `value` computed once, however often it's used."""
    return F.transform(F.array(value), use)[0]


def composed(text: Column, words: dict[str, str] = fixed.STOP_WORDS) -> Column:
    """Lower case, with the letters of the words composed where they stand as a base and combining marks, longest first.

    For comparing words that is the whole canonical form: other letters are in none of them, in either form.
    """
    low = F.lower(text)
    letters = {unicodedata.normalize("NFD", c): c for c in "".join(words.values()) if unicodedata.normalize("NFD", c) != c}
    pairs = sorted(letters.items(), key=lambda x: (-len(x[0]), x[0]))
    return F.when(low.rlike(r"\p{M}"), reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), pairs, low)).otherwise(low)


def detected_language(text: Column) -> Column:
    """By script, else by stop words: two hits and a strict winner, or null."""
    listed = {k: v.split() for k, v in fixed.STOP_WORDS.items()}
    all_words = sorted({w for words in listed.values() for w in words})
    hits = F.filter(F.split(composed(text), r"[^\p{L}\p{M}'’]+"), lambda w: w.isin(*all_words))

    def winner(counts: Column) -> Column:
        best = F.sort_array(counts, asc=False)
        return _once(best, lambda b: F.when((b[0]["n"] >= 2) & (b[0]["n"] > b[1]["n"]), b[0]["lang"]))

    def one_of(words: list[str]):
        return lambda w: w.isin(*words)

    by_words = winner(_once(hits, lambda h: F.array(*[F.struct(F.size(F.filter(h, one_of(v))).alias("n"), F.lit(k).alias("lang")) for k, v in listed.items()])))
    any_script = "[" + "".join(pattern[1:-1] for _, pattern in fixed.SCRIPTS) + "]"  # one look at a text that has none of them
    by_script = reduce(lambda acc, s: F.when(text.rlike(s[1]), s[0]).otherwise(acc), reversed(fixed.SCRIPTS), F.lit(None).cast("string"))
    return F.when(F.length(F.trim(text)) > 0, F.when(text.rlike(any_script), by_script).otherwise(by_words))


def expected_language(market: Column) -> Column:
    return lookup(fixed.MARKET_LANGUAGE, market)


def localization_gap(text: Column, expected: Column, found: Column | None = None) -> Column:
    """0 if the text is in the expected language, 10 if in another, 5 if there's no telling; found: its language, if known."""
    found = detected_language(text) if found is None else found
    blank = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
    return _once(found, lambda f: F.when(blank | expected.isNull() | f.isNull(), 5.0).when(f == expected, 0.0).otherwise(10.0))


def epoch_ms(text: Column) -> Column:
    """Digits up to ten long are seconds, longer ones milliseconds, anything else an ISO or English date; else null."""
    t = F.trim(text)
    parsed = F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("MMM d, yyyy")))
    return F.when(t.rlike("^[0-9]{1,10}$"), t.try_cast("bigint") * 1000).when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).otherwise(F.unix_millis(parsed))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fixed_text(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x.cast("double"))


def judge_text_digest(model: Column, description: Column, name: Column, developer: Column, category: Column, market: Column) -> Column:
    """What a text judge sees of an app, as a digest: 1500 characters of its description and its names."""
    return F.sha2(F.concat_ws("|", model, F.substring(F.coalesce(description, F.lit("")), 1, 1500), name, developer, category, market), 256)


def judge_image_digest(model: Column, urls: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("|"), F.array_join(F.transform(urls, lambda u: F.concat(u, F.lit("\n"))), "")), 256)


def judge_key(version: Column, kind: Column, model: Column, app_id: Column, market: Column, digest: Column) -> Column:
    return F.concat(F.lit("judge:"), F.substring(F.sha2(F.concat_ws("|", version, kind, model, app_id, market, digest), 256), 1, 32))


def composite_key(kind: str, *segments: Column) -> Column:
    """kind and percent-encoded segments between colons; a blank is %20 and !'()*~ stay."""
    one = [reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")), F.url_encode(s.cast("string"))) for s in segments]
    return F.concat_ws(":", F.lit(kind), *one)


def participation(*signals: Column) -> list[Column]:
    """1 for each signal that is there and finite, else 0."""
    return [F.when(finite(s.cast("double")).isNotNull(), 1).otherwise(0) for s in signals]


def between_headings(text: Column, heading: str) -> Column:
    """The text under a bold heading up to the next bold one, trimmed; null without both."""
    found = F.regexp_extract(text, rf"(?s)\*\*{heading}\*\*\n(.*?)\n\n\*\*", 1)
    return F.when(F.length(found) > 0, F.trim(found))


def content_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def fill_template(template: Column, tokens: Column) -> Column:
    """{{name}} replaced by the map's values, null as nothing; unknown names stay."""
    return F.reduce(F.map_entries(tokens), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def store_link(store: Column, app_id: Column, track_id: Column, market: Column) -> Column:
    return F.when(store == "apple", F.concat(F.lit("https://apps.apple.com/"), market, F.lit("/app/id"), F.coalesce(track_id, app_id))).otherwise(
        F.concat(F.lit("https://play.google.com/store/apps/details?id="), app_id, F.lit("&gl="), market)
    )


def pattern_tags(loc_gap: Column, velocity: Column, vulnerability: Column, economics: Column, tier2: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when((loc_gap > 7) & tier2, "tier2-localization"),
            F.when((velocity > 7) & (loc_gap.isNull() | (loc_gap < 4)), "hot-wave"),
            F.when((vulnerability > 7) & (economics > 6), "incumbent-toppling"),
        )
    )
