"""Link health: reasons, access patterns, trusted overrides, refetch decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, urls


def http_reason(status_code: Column) -> Column:
    code = status_code.try_cast("int")
    return (
        F.when(code.isin(401, 403), "access_denied").when(code == 429, "rate_limited").when(code.isin(404, 410), "not_found")
        .when(code.between(500, 599), "server_error").otherwise("http_error")
    )


def _mentions(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def reason(status: Column, status_code: Column, error: Column) -> Column:
    """The reason code of a fetch result."""
    said = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status == "success", "ok").when(status == "timeout", "timeout").when(status == "broken", http_reason(status_code))
        .when(status == "skipped", "invalid_url").when(_mentions(said, lexicon.CERTIFICATE_MARKERS), "certificate")
        .when(_mentions(said, lexicon.NETWORK_MARKERS), "dns_connection").otherwise("other_error")
    )


def access_pattern(status: Column, code: Column) -> Column:
    return (
        F.when(status == "success", "public").when(code.isin("access_denied", "rate_limited", "trusted_access"), "access_limited").when(code == "not_found", "missing")
        .when(code == "server_error", "server_error").when(status.isin("timeout", "error"), "transport_error").otherwise("unknown")
    )


def link_health(rows: DataFrame) -> DataFrame:
    """Rows with status, status_code and error, and what follows from them."""
    names = F.create_map(*[F.lit(x) for pair in lexicon.REASON_LABELS.items() for x in pair])
    actions = F.create_map(*[F.lit(x) for pair in lexicon.ACTION_LABELS.items() for x in pair])
    rows = rows.withColumn("reason_code", reason(F.col("status"), F.col("status_code"), F.col("error")))
    return rows.withColumns({
        "reason_label": names[F.col("reason_code")], "access_pattern": access_pattern(F.col("status"), F.col("reason_code")),
        "review_required": F.col("status") != "success", "user_action_required": F.col("reason_code").isin(*lexicon.ACTION_LABELS),
        "user_action_label": F.coalesce(F.try_element_at(actions, F.col("reason_code")), F.lit("")),
    })


class TrustRule:
    """Domain suffixes whose failures with these statuses or reasons need no review."""

    def __init__(self, suffixes: tuple[str, ...], statuses: tuple[int, ...] = (), reasons: tuple[str, ...] = ()):
        self.suffixes, self.statuses, self.reasons = suffixes, statuses, reasons


def trust_rules(policy: dict | None) -> list[TrustRule]:
    """The rules of a policy document in the order they are tried: those of domains, which override the base's lists, then the base; none if it is off."""
    policy = policy or {}
    if not policy.get("enabled"):
        return []
    base = {k: policy.get(k, []) for k in ("http_statuses", "allow_reason_codes")}
    rules = [base | r for r in policy.get("domain_rules", [])] + [base | {"domain_suffixes": policy.get("domain_suffixes", [])}]
    return [TrustRule(tuple(r.get("domain_suffixes", ())), tuple(r["http_statuses"]), tuple(r["allow_reason_codes"])) for r in rules if r.get("domain_suffixes")]


def apply_trust(rows: DataFrame, rules: list[TrustRule], host: str = "host") -> DataFrame:
    """The first rule that a host matches decides: rows it allows are trusted, need no review nor the user, and count as limited; raw values stay."""
    domain = F.btrim(F.lower(F.coalesce(host, F.lit(""))), F.lit("."))
    matched, suffix = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, rule in reversed(list(enumerate(rules))):
        named = [F.btrim(F.lower(F.lit(s)), F.lit(".")) for s in rule.suffixes]
        found = F.get(F.filter(F.array(*named), lambda s: urls.has_suffix(domain, s)), F.lit(0))
        matched = F.when(found.isNotNull(), F.lit(n)).otherwise(matched)
        suffix = F.when(found.isNotNull(), found).otherwise(suffix)
    allowed = F.lit(False)
    for n, rule in enumerate(rules):
        ok = F.lit(False)
        if rule.statuses:
            ok = ok | F.coalesce(F.col("status_code").isin(*rule.statuses), F.lit(False))
        if rule.reasons:
            ok = ok | F.col("reason_code").isin(*rule.reasons)
        allowed = allowed | ((F.col("__rule") == n) & ok)
    rows = rows.withColumns({"__rule": matched, "__suffix": suffix}).withColumn("trusted_override", F.coalesce(allowed, F.lit(False)))
    on = F.col("trusted_override")
    kept = {"reason_code": F.lit("trusted_access"), "reason_label": F.lit(lexicon.REASON_LABELS["trusted_access"]), "access_pattern": F.lit("access_limited"), "review_required": F.lit(False), "user_action_required": F.lit(False), "user_action_label": F.lit("")}
    raw = {f"raw_{x}": F.col(x) for x in ("reason_code", "reason_label", "review_required")}
    rows = rows.withColumns(raw).withColumn("trusted_domain", F.when(on, F.col("__suffix")))
    return rows.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in kept.items()}).drop("__rule", "__suffix")


def longest_override(rows: DataFrame, overrides: DataFrame, host: str = "host") -> DataFrame:
    """Each row with the setting of the longest matching suffix: host suffixes are exploded, so the join is by equality."""
    hosts = rows.select(F.col(host).alias("__host")).distinct()
    best = (
        hosts.select("__host", F.split("__host", r"\.").alias("__labels"))
        .select("__host", F.explode(F.transform(F.sequence(F.lit(1), F.size("__labels")), lambda n: F.array_join(F.slice(F.col("__labels"), n, F.size("__labels")), "."))).alias("suffix"))
        .join(overrides, "suffix").groupBy("__host").agg(F.max_by("setting", F.length("suffix")).alias("setting"))
    )
    return rows.join(best, F.col(host) == F.col("__host"), "left").drop("__host")


def refetch(has_cache: Column, review_required: Column, status: Column, force: bool = False) -> Column:
    retry = review_required & status.isin("timeout", "error", "broken", "skipped")
    return F.lit(force) | ~has_cache | F.coalesce(retry, F.lit(False))


def cache_priority(status: Column, review_required: Column) -> Column:
    return F.when(status == "success", 4).when(~review_required, 3).when(status == "broken", 2).when(status.isin("timeout", "error", "skipped"), 1).otherwise(0)


def merge_cache(links: DataFrame, cache: DataFrame, key: str, *, force: bool = False) -> DataFrame:
    """Links with their best cached row (priority, then the latest by ``ord``) and whether they are pending.

    The best row is a max over a struct, so it is combined before the shuffle.
    """
    value = F.struct(cache_priority(F.col("status"), F.col("review_required")).alias("priority"), "ord", "status", "review_required")
    best = cache.groupBy(key).agg(F.max(value).alias("c"))
    found = links.join(best, key, "left")
    pending = refetch(F.col("c").isNotNull(), F.coalesce(F.col("c.review_required"), F.lit(False)), F.col("c.status"), force)
    return found.select(*links.columns, F.col("c.status").alias("cached_status"), F.col("c.priority").alias("cached_priority"), pending.alias("pending"))
