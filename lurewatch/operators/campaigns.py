"""Campaigns: indicator rows, lossless blocked similarity join, components, aggregates, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import attach, pair_chunks, written

#: Weights of the pair similarity and of the confidence, and mail providers that many share.
PAIR_WEIGHTS = {"ioc": 0.35, "infra": 0.30, "subject": 0.15, "temporal": 0.10, "behaviour": 0.10}
CONFIDENCE_WEIGHTS = {"infrastructure": 0.35, "temporal": 0.25, "behaviour": 0.25, "content": 0.15}
SHARED_PROVIDERS = ("gmail.com", "outlook.com", "yahoo.com")
DEFAULT_THRESHOLD = 0.45
#: Without a shared indicator a pair can't score more.
UNBLOCKED_MOST = 0.35
#: Emails of an indicator that one task compares with each other, on average.
CHUNK = 1024
#: Sets of an email that the similarity join holds 64-bit marks of.
MARKED = ("payload", "place", "words")
#: Emails from which on an indicator alone is no key of the similarity join.
HOT = 256
#: Spans in hours of the time part of the similarity, the part, and the part if a time is unknown.
CLOSE = ((1, 1.0), (24, 0.85), (72, 0.6), (None, 0.3))
UNKNOWN_TIME = 0.5


def _set(column: str, when: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(when, F.col(column))))


def indicator_rows(emails: DataFrame, iocs: DataFrame, resolves: DataFrame) -> DataFrame:
    """Each email with sorted arrays domains, urls, hashes, ips.

    ``iocs(email_id, kind, value)``; ``resolves(domain, ip)``.  Addresses of the
    sender's domain count only if the email contains no domain or one without
    an address.  Each branch is aggregated before it is joined.
    """
    found = iocs.groupBy("email_id").agg(*(_set("value", F.col("kind") == k).alias(n) for k, n in (("domain", "domains"), ("url", "urls"), ("hash", "hashes"))))
    contained = iocs.filter("kind = 'domain'").select("email_id", F.col("value").alias("domain")).join(resolves, "domain", "left")
    contained = contained.groupBy("email_id").agg(F.collect_set("ip").alias("own_ips"), F.bool_or(F.col("ip").isNull()).alias("open"))
    sent = emails.select("email_id", F.col("sender_domain").alias("domain")).join(resolves, "domain").groupBy("email_id").agg(F.collect_set("ip").alias("sender_ips"))
    rows = emails.join(found, "email_id", "left").join(contained, "email_id", "left").join(sent, "email_id", "left")
    none = F.array().cast("array<string>")
    sender = F.when(F.coalesce("open", F.lit(True)), F.coalesce("sender_ips", none)).otherwise(none)
    ips = F.array_sort(F.array_union(F.coalesce("own_ips", none), sender))
    filled = {c: F.coalesce(F.col(c), none) for c in ("domains", "urls", "hashes")}
    known = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("spf", "dkim", "dmarc", "classification")}
    return rows.withColumns({**filled, **known, "ips": ips}).drop("own_ips", "open", "sender_ips")


def _subject_words(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(subject, F.lit(""))), r"\s+"), lambda w: w != ""))


def prepared(rows: DataFrame) -> DataFrame:
    """Per email the sets that the pair similarity compares."""
    sender = F.when(F.coalesce("sender_domain", F.lit("")) != "", F.array("sender_domain")).otherwise(F.array().cast("array<string>"))
    payload = F.concat(F.transform("urls", lambda u: F.concat(F.lit("u:"), u)), F.transform("hashes", lambda h: F.concat(F.lit("h:"), h)))
    domains = F.array_union("domains", sender)
    place = F.concat(F.transform(domains, lambda d: F.concat(F.lit("d:"), d)), F.transform("ips", lambda i: F.concat(F.lit("i:"), i)))
    return rows.select("email_id", payload.alias("payload"), place.alias("place"), _subject_words(F.col("subject")).alias("words"), F.unix_micros("ts").alias("us"), "spf", "dmarc", "classification")


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _closeness(us: Column, other: Column) -> Column:
    hours = F.abs(us - other) / 3.6e9
    return F.when(hours.isNull(), 0.5).when(hours <= 1, 1.0).when(hours <= 24, 0.85).when(hours <= 72, 0.6).otherwise(0.3)


def _alike(x, y) -> Column:
    same = lambda c: (x(c) == y(c)) & (x(c) != "unknown")
    return (same("spf").cast("int") + same("dmarc").cast("int") + (x("classification") == y("classification")).cast("int")) / 3.0


def similarity(a: str, b: str) -> dict[str, Column]:
    """The parts of the similarity of rows ``prepared`` under aliases a and b, and ``score``."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    shared = F.array_intersect(x("place"), y("place"))
    doms = F.filter(shared, lambda v: v.startswith("d:"))
    strong = (F.size(doms) < F.size(shared)) | ((F.size(doms) > 0) & ~F.exists(doms, lambda v: F.substring(v, 3, 300).isin(*SHARED_PROVIDERS)))
    infra = _jaccard(x("place"), y("place"))
    parts = {
        "ioc": _jaccard(x("payload"), y("payload")),
        "infra": F.when(strong, F.greatest(infra, F.lit(0.8))).otherwise(infra),
        "subject": _jaccard(x("words"), y("words")),
        "temporal": _closeness(x("us"), y("us")),
        "behaviour": _alike(x, y),
    }
    total = sum((parts[k] * w for k, w in PAIR_WEIGHTS.items()), F.lit(0.0))
    return {**parts, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))}


def _rarest_first(rows: DataFrame, column: str) -> DataFrame:
    """email_id and ``order``: structs (df, x) of the column's elements x, those that the fewest emails have first."""
    each = rows.select("email_id", F.explode(column).alias("x"))
    counts = each.groupBy("x").agg(F.count("*").alias("size")).withColumn("df", F.col("size"))
    return attach(each, counts, "x", "size", F.col("email_id")).groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("order"))


def ordered(ready: DataFrame) -> DataFrame:
    """``prepared`` rows with their places and words, the rarest first, as a written table."""
    none = F.array().cast("array<struct<df:bigint,x:string>>")
    for c in ("place", "words"):
        ready = ready.join(_rarest_first(ready, c).withColumnRenamed("order", f"{c}_order"), "email_id", "left").withColumn(f"{c}_order", F.coalesce(f"{c}_order", none))
    return written(ready, "ordered")


def _prefix(order: Column, least: float) -> Column:
    """The first elements of a set, of which a set that shares ``least`` of the union has one among its own first."""
    n = F.size(order)
    return F.transform(F.slice(order, F.lit(1), F.greatest(n - F.ceil(n * max(least, 0.0) - 1e-9).cast("int") + 1, F.lit(0))), lambda v: v["x"])


def _block_keys(ready: DataFrame, threshold: float) -> Column:
    """Keys of ``ordered`` emails such that two which share an indicator and may reach ``threshold`` share one.

    Indicators themselves, but in place of a domain or address of over ``HOT`` emails
    narrower keys.  Two emails that share it and no payload need one of three: nearly
    equal places (part over the floor), so one of the rarest in common; times within
    a span, so a stretch of time in common; or far apart a share of the subject's
    words, so one of the rarest in common.
    """
    w, floor = PAIR_WEIGHTS, 0.8
    payload, order = F.transform("payload", lambda v: F.concat(F.lit("p "), v)), F.col("place_order")
    needed = lambda t: (threshold - 0.0005 - w["infra"] * floor - w["temporal"] * t - w["behaviour"]) / w["subject"]
    far = CLOSE[-1][1] if ready.filter("us IS NULL").isEmpty() else UNKNOWN_TIME
    if needed(far) <= 1e-9:  # any two emails with a common indicator may do
        return F.array_union(payload, F.transform("place", lambda v: F.concat(F.lit("i "), v)))
    cold = F.transform(F.filter(order, lambda v: v["df"] <= HOT), lambda v: F.concat(F.lit("i "), v["x"]))
    hot = F.transform(F.filter(order, lambda v: v["df"] > HOT), lambda v: v["x"])
    under = lambda kind, parts: F.flatten(F.transform(hot, lambda h: F.transform(parts, lambda x: F.concat_ws("\n", F.lit(kind), h, x))))
    keys = [payload, cold, F.transform(_prefix(order, floor), lambda v: F.concat(F.lit("r "), v))]
    if spans := [hours for hours, t in CLOSE[:-1] if needed(t) <= 1]:
        k = F.floor(F.col("us") / int(max(spans) * 3.6e9))
        keys.append(under("t", F.when(k.isNotNull(), F.array(k.cast("string"), (k + 1).cast("string"))).otherwise(F.array().cast("array<string>"))))
    if needed(far) <= 1:
        keys.append(under("w", _prefix(F.col("words_order"), needed(far))))
    return F.array_distinct(F.concat(*keys))


def keyed(ready: DataFrame, threshold: float) -> DataFrame:
    """``ordered`` emails as the join judges them, as a written table: their sets as 64-bit hashes, a 64-bit mark of each, and the hashes of their keys, sorted.

    Rows that meet under a key are compared by these alone, so neither pairs nor texts
    are shuffled.  Two keys of one hash only meet more often than needed.
    """
    hashes = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda v: F.xxhash64(v))))
    shared = F.filter("place", lambda v: v.isin(*(f"d:{p}" for p in SHARED_PROVIDERS)))
    ips = F.when(F.size(shared) > 0, F.filter("place", lambda v: v.startswith("i:"))).otherwise(F.array().cast("array<string>"))
    sets = {"payload": F.col("payload"), "place": F.col("place"), "words": F.col("words"), "providers": shared, "provider_ips": ips, "keys": _block_keys(ready, threshold)}
    own = ["component"] if "component" in ready.columns else []
    out = ready.select("email_id", *own, "us", "spf", "dmarc", "classification", *(hashes(c).alias(k) for k, c in sets.items()))
    mark = {f"mark_{c}": F.expr(f"aggregate({c}, 0L, (a, x) -> a | shiftleft(1L, cast(pmod(x, 64L) AS INT)))") for c in MARKED}
    return written(out.withColumns(mark), "keyed")


def _overlap(a: Column, b: Column) -> Column:
    """Whether two short arrays have an element in common.

    Written with a lambda: Spark then compiles the expressions beside it as many short
    methods; fused into one long method with the join they would never be compiled to
    machine code.
    """
    return F.exists(a, lambda v: F.array_contains(b, v))


def _in_common(x, y) -> dict[str, Column]:
    """Of two ``keyed`` emails: how many elements of each set they share, and whether the places would be strong evidence."""
    some = lambda c: x(f"mark_{c}").bitwiseAND(y(f"mark_{c}")) != 0
    counts = {c: F.when(some(c), F.size(F.array_intersect(x(c), y(c)))).otherwise(0) for c in MARKED}
    return {**counts, "strong": ~_overlap(x("providers"), y("providers")) | _overlap(x("provider_ips"), y("provider_ips"))}


def _judged_parts(x, y, common) -> dict[str, Column]:
    """The parts of ``similarity`` and the score of two ``keyed`` emails, from what they have in common."""
    like = lambda c: F.when(x(f"n_{c}") + y(f"n_{c}") > 0, common(c) / (x(f"n_{c}") + y(f"n_{c}") - common(c))).otherwise(0.0)
    infra = like("place")
    parts = {
        "ioc": like("payload"),
        "infra": F.when((common("place") > 0) & common("strong"), F.greatest(infra, F.lit(0.8))).otherwise(infra),
        "subject": like("words"),
        "temporal": _closeness(x("us"), y("us")),
        "behaviour": _alike(x, y),
    }
    total = sum((parts[k] * w for k, w in PAIR_WEIGHTS.items()), F.lit(0.0))
    return {**parts, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))}


def _met(each: DataFrame, keys: str, threshold: float, inside) -> DataFrame:
    """Pairs (a, b) of emails that share one of ``keys``, that ``inside(x, y)`` lets pass and that reach ``threshold``, with the parts.

    A key's emails are dealt over chunks, and each pair of chunks is a join key of its
    own, so a key that very many emails share becomes many tasks.  A pair is judged
    where it meets, and counts under the least key that both have: each email brings
    its lesser keys along.
    """
    columns = [c for c in each.columns if c not in {"keys", keys}]
    rows = each.select(*columns, keys, F.posexplode(keys).alias("at", "key"))
    rows = rows.select(*columns, F.slice(keys, F.lit(1), F.col("at")).alias("lesser"), "key")
    left, right, meet = pair_chunks(rows, "key", "email_id", CHUNK)
    x, y = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    both = left.join(right, meet & inside(x, y) & ~_overlap(x("lesser"), y("lesser")))
    kept = [f"{c}_{side}" for c in ("email_id", "us", "spf", "dmarc", "classification") for side in "xy"]
    sizes = [F.size(side(c)).alias(f"n_{c}_{name}") for c in MARKED for side, name in ((x, "x"), (y, "y"))]
    both = both.select(*kept, *sizes, F.struct(*(c.alias(k) for k, c in _in_common(x, y).items())).alias("counted"))
    both = both.select("*", F.explode(F.array("counted")).alias("common"))  # so that it is counted once a pair, not again in the filter
    parts = _judged_parts(x, y, lambda c: F.col(f"common.{c}"))
    both = both.filter(F.round(parts["score"], 3) >= threshold)
    return both.select(F.least(x("email_id"), y("email_id")).alias("a"), F.greatest(x("email_id"), y("email_id")).alias("b"), *(c.alias(k) for k, c in parts.items()))


def indicator_pairs(each: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``keyed`` emails that share an indicator and reach ``threshold``, with the parts; none within a ``component``, if they have one.

    Before the sets are compared, an upper bound must reach the threshold: the exact
    time and behaviour parts, and for each pair of sets the common bits of their marks,
    plus the smaller number of collisions within a set, as the most that they share.
    """
    own = ["component"] if "component" in each.columns else []

    def inside(x, y) -> Column:
        n = lambda z, c: F.size(z(c))
        common = lambda c: x(f"mark_{c}").bitwiseAND(y(f"mark_{c}"))
        spare = lambda z, c: n(z, c) - F.bit_count(z(f"mark_{c}"))
        shared = lambda c: F.least(F.bit_count(common(c)) + F.least(spare(x, c), spare(y, c)), n(x, c), n(y, c))
        alike = lambda c: F.when(common(c) != 0, shared(c) / (n(x, c) + n(y, c) - shared(c))).otherwise(0.0)
        w, least = PAIR_WEIGHTS, threshold - 0.001
        infra = F.when(common("place") == 0, 0.0).when(5 * shared("place") >= 4 * F.greatest(n(x, "place"), n(y, "place")), w["infra"]).otherwise(w["infra"] * 0.8)
        sets_most = w["ioc"] * alike("payload") + infra + w["subject"] * alike("words")
        gap = F.abs(x("us") - y("us"))
        near = F.when(gap <= int(CLOSE[0][0] * 3.6e9), w["temporal"]).when(gap <= int(CLOSE[2][0] * 3.6e9), w["temporal"] * CLOSE[1][1]).when(gap.isNull(), w["temporal"] * UNKNOWN_TIME).otherwise(w["temporal"] * CLOSE[3][1])
        apart = reduce(Column.__and__, [x(c) != y(c) for c in own], F.lit(True))
        return apart & (sets_most + near + w["behaviour"] * _alike(x, y) >= least)

    return _met(each, "keys", threshold, inside)


def sure_links(ready: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``ordered`` emails that are similar at ``threshold`` whatever else they hold: those with a hot place, all subject words and a verdict in common, each with the least of them.

    They score at least 0.24 for the place, 0.15 for the words, 0.03 for the time and
    0.033 for the verdict.  A domain counts if the email has no shared provider.
    """
    w = PAIR_WEIGHTS
    enough = w["infra"] * 0.8 + w["subject"] + w["temporal"] * CLOSE[-1][1] + w["behaviour"] / 3 >= threshold - 0.0005 + 1e-9
    common = F.exists("place", lambda v: v.isin(*(f"d:{p}" for p in SHARED_PROVIDERS)))
    places = F.transform(F.filter("place_order", lambda v: (v["df"] > HOT) & (v["x"].startswith("i:") | ~common)), lambda v: v["x"])
    known = lambda c: F.when(F.col(c) != "unknown", F.concat(F.lit(f"{c} "), c))
    verdicts = F.array_compact(F.array(known("spf"), known("dmarc"), F.concat(F.lit("classification "), "classification")))
    each = ready.filter((F.size("words") > 0) & F.lit(enough)).select("email_id", F.array_sort("words").alias("subject"), places.alias("places"), verdicts.alias("verdicts"))
    each = each.select("email_id", F.col("subject").alias("words"), F.explode("places").alias("place"), "verdicts")
    each = each.select("email_id", F.explode("verdicts").alias("verdict"), "place", "words").select("email_id", F.sha2(F.to_json(F.struct("place", "verdict", "words")), 256).alias("key"))
    first = each.groupBy("key").agg(F.min("email_id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    return attach(each, first, "key", "size", F.col("email_id")).filter("email_id <> first").select(F.col("first").alias("a"), F.col("email_id").alias("b")).distinct()


def links(rows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs (a, b) that are similar at ``threshold``: not all, but enough that components are those of all ``similar_pairs``.

    Groups of emails that are all similar to each other become stars; candidates are
    then sought only across the components that the stars make.
    """
    if threshold <= UNBLOCKED_MOST:
        return similar_pairs(rows, threshold).select("a", "b")
    ready = ordered(prepared(rows))
    sure = written(sure_links(ready, threshold), "sure-links")
    stars = components(sure).withColumnRenamed("node", "email_id")
    apart = written(ready.join(stars, "email_id", "left").withColumn("component", F.coalesce("component", "email_id")), "apart")
    return sure.unionByName(indicator_pairs(keyed(apart, threshold), threshold).select("a", "b"))


#: From this threshold on pairs that share neither an indicator nor a subject word lie within 72 hours; below it any two emails of like behaviour qualify.
LEAST_THRESHOLD = 0.16


def unblocked_pairs(ready: DataFrame, each: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of emails that share no indicator and reach ``threshold``, at most 0.35, with the parts; ``each``: the ``ordered`` emails ``ready``, ``keyed``.

    Such a pair needs ``0.15 J + 0.10 T + 0.10 B >= threshold`` of its subjects' Jaccard
    J, time part T and behaviour part B.  For each span of T, with B at its most, that
    says which J is needed at least.  None: the emails of two neighbouring stretches of
    time of the span's length meet.  Some: they must share one of the first
    ``n - ceil(J n) + 1`` of their n subject words, the rarest first, and meet under that
    word, in the stretch of time if the span has an end.  A pair counts in its own span only.
    """
    w = PAIR_WEIGHTS
    least = threshold - 0.0005  # scores are rounded to 3 digits
    needed = lambda t: (least - w["temporal"] * t - w["behaviour"]) / w["subject"]
    rows = written(each.drop("keys").join(ready.select("email_id", F.transform("words_order", lambda v: v["x"]).alias("order")), "email_id"), "subject-order")

    def stretches(hours: int | None) -> Column:
        """The email's stretches of time, such that two within the span share one; one for all without a span."""
        if hours is None:
            return F.array(F.lit(0).cast("long"))
        k = F.floor(F.col("us") / int(hours * 3.6e9))
        return F.array(k, k + 1)

    found, closer = [], -1
    for hours, t in (*CLOSE, ("unknown", UNKNOWN_TIME)):
        past, closer = closer, hours
        j = needed(t)
        if j > 1:
            continue
        some = rows if hours == "unknown" else rows.filter("us IS NOT NULL")
        where = stretches(None if hours == "unknown" else hours)
        first = F.slice("order", F.lit(1), F.size("order") - F.ceil(F.size("order") * max(j, 0.0) - 1e-9).cast("int") + 1) if j > 1e-9 else F.array(F.lit(""))
        keys = F.flatten(F.transform(first, lambda x: F.transform(where, lambda k: F.xxhash64(F.concat(k.cast("string"), F.lit(" "), x)))))  # noqa: B023

        def inside(x, y, hours=hours, past=past) -> Column:
            alike = F.least(F.size(x("words")), F.size(y("words"))) / F.greatest(F.size(x("words")), F.size(y("words")), F.lit(1))  # J at its most
            most = w["subject"] * alike + w["temporal"] * _closeness(x("us"), y("us")) + w["behaviour"] * _alike(x, y)
            gap = F.abs(x("us") - y("us")) / 3.6e9
            own = gap.isNull() if hours == "unknown" else (gap > past) & (F.lit(True) if hours is None else gap <= hours)
            apart = ~_overlap(x("payload"), y("payload")) & ~_overlap(x("place"), y("place"))
            return own & (most >= least - 1e-9) & apart

        found.append(_met(some.withColumn("under", F.array_sort(F.array_distinct(keys))).drop("order"), "under", threshold, inside))
    return reduce(DataFrame.unionByName, found) if found else indicator_pairs(each.limit(0), threshold)


def similar_pairs(rows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs (a, b, a < b) with a score, rounded to 3 digits, of at least ``threshold``, and the parts.

    A pair without a shared indicator scores at most 0.35, so above that a join on
    the indicators (``indicator_pairs``) finds every pair; from ``LEAST_THRESHOLD`` on
    subject words and time find the others (``unblocked_pairs``).  Both judge a pair
    where it meets, and only once.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"below a threshold of {LEAST_THRESHOLD} emails that have nothing but their behaviour in common count as similar")
    ready = ordered(prepared(rows))
    each = keyed(ready, threshold)
    pairs = indicator_pairs(each, threshold)
    return pairs.unionByName(unblocked_pairs(ready, each, threshold)) if threshold <= UNBLOCKED_MOST else pairs


def members(rows: DataFrame, threshold: float = DEFAULT_THRESHOLD, min_size: int = 2, linked: DataFrame | None = None) -> DataFrame:
    """email_id, component (its least email) and campaign_id of emails in components of ``min_size`` or more.

    ``linked``: pairs (a, b) enough for the components, such as ``links``; all similar pairs if not given.
    The id is a digest of the component's least email, its size and the sum of its
    emails' digests: the same for the same emails, and computed without a list of them.
    """
    if min_size < 2:
        raise ValueError("emails without a similar one form no campaign")
    linked = similar_pairs(rows, threshold).select("a", "b") if linked is None else linked
    found = written(components(linked).withColumnRenamed("node", "email_id"), "components")
    part = F.conv(F.left(F.md5("email_id"), F.lit(15)), 16, 10).cast("decimal(20,0)")
    ids = found.groupBy("component").agg(F.count("*").alias("size"), F.sum(part).alias("digest")).filter(F.col("size") >= min_size)
    name = F.concat_ws(":", "component", F.col("size").cast("string"), F.col("digest").cast("string"))
    named = ids.select("component", "size", F.concat(F.lit("camp-"), F.left(F.sha2(name, 256), F.lit(12))).alias("campaign_id"))
    return written(attach(found, named, "component", "size", F.col("email_id")).select("email_id", "component", "campaign_id"), "campaign-members")


def used_indicators(rows: DataFrame, members: DataFrame) -> DataFrame:
    """campaign_id, kind, value, n_emails of indicators in at least two emails of the campaign."""
    sender = F.when(F.coalesce("sender_domain", F.lit("")) != "", F.array("sender_domain")).otherwise(F.array().cast("array<string>"))
    of = {"domain": F.array_union("domains", sender), "ip": F.col("ips"), "url": F.col("urls"), "hash": F.col("hashes")}

    def labelled(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    each = F.concat(*(labelled(k, v) for k, v in of.items()))
    flat = rows.select("email_id", F.explode(each).alias("i")).join(members.select("email_id", "campaign_id"), "email_id")
    return flat.groupBy("campaign_id", F.col("i.kind").alias("kind"), F.col("i.value").alias("value")).agg(F.count("*").alias("n_emails")).filter("n_emails >= 2")


def campaigns(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per campaign: size, span, mean risk, shared indicators, confidence, reasons."""
    joined = rows.join(members.select("email_id", "campaign_id"), "email_id")
    base = joined.groupBy("campaign_id").agg(F.count("*").alias("email_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.avg("risk_score").alias("mean_risk"))
    used = used_indicators(rows, members).groupBy("campaign_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(f"shared_{k}s") for k in ("domain", "ip", "url")), F.array_sort(F.collect_list(F.when(F.col("kind") == "hash", F.col("value")))).alias("shared_hashes"))
    none = F.array().cast("array<string>")
    names = ("shared_domains", "shared_ips", "shared_urls", "shared_hashes")
    out = base.join(used, "campaign_id", "left").withColumns({c: F.coalesce(F.col(c), none) for c in names})
    n = {c: F.size(c) for c in names}
    infra = F.least(F.lit(1.0), n["shared_domains"] * 0.3 + n["shared_ips"] * 0.4 + n["shared_hashes"] * 0.3)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.4), infra * 0.6 + F.col("mean_risk") * 0.4))
    reasons = F.array_compact(
        F.array(
            F.when(n["shared_domains"] > 0, F.concat(n["shared_domains"].cast("string"), F.lit(" shared domain(s)"))),
            F.when(n["shared_ips"] > 0, F.concat(n["shared_ips"].cast("string"), F.lit(" shared address(es)"))),
            F.when(n["shared_urls"] > 0, F.concat(n["shared_urls"].cast("string"), F.lit(" shared link(s)"))),
            F.when(n["shared_hashes"] > 0, F.concat(n["shared_hashes"].cast("string"), F.lit(" shared payload(s)"))),
            F.concat(F.col("email_count").cast("string"), F.lit(" correlated messages")),
        )
    )
    return out.withColumns({"confidence": confidence, "reasons": reasons})


def campaign_edges(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Edges MEMBER_OF and USES_*: src_label, src_key, rel, dst_label, dst_key."""
    belong = members.select(F.lit("Email").alias("src_label"), F.col("email_id").alias("src_key"), F.lit("MEMBER_OF").alias("rel"), F.lit("Campaign").alias("dst_label"), F.col("campaign_id").alias("dst_key"))
    label = F.expr("CASE kind WHEN 'domain' THEN 'Domain' WHEN 'ip' THEN 'IP' WHEN 'url' THEN 'URL' ELSE 'Hash' END")
    key = F.when(F.col("kind") == "url", F.sha2("value", 256)).otherwise(F.col("value"))
    use = used_indicators(rows, members).select(F.lit("Campaign").alias("src_label"), F.col("campaign_id").alias("src_key"), F.concat(F.lit("USES_"), F.upper("kind")).alias("rel"), label.alias("dst_label"), key.alias("dst_key"))
    return belong.unionByName(use)


def details(campaigns: DataFrame, campaign_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Campaigns, the most confident and earliest first; one, or the first ``limit``.  ``membership`` lists their emails."""
    out = campaigns.filter(F.col("campaign_id") == campaign_id) if campaign_id else campaigns
    out = out.orderBy(F.desc("confidence"), F.desc("first_seen"), "campaign_id")
    return out.limit(limit) if limit else out


def membership(campaigns: DataFrame, members: DataFrame) -> DataFrame:
    """A row (campaign_id, email_id) for each email of these campaigns."""
    return members.select("campaign_id", "email_id").join(campaigns.select("campaign_id"), "campaign_id", "left_semi")


def telemetry(rows: DataFrame, members: DataFrame) -> DataFrame:
    """What the confidence is computed from, each branch aggregated by itself."""
    joined = rows.join(members.select("email_id", "campaign_id"), "email_id")
    count = lambda cond: F.count_if(cond)
    base = joined.groupBy("campaign_id").agg(
        F.count("*").alias("n_emails"), F.count("ts").alias("n_times"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("span_hours"),
        count(F.col("spf").isin("fail", "softfail")).alias("spf_bad"), count(F.col("dmarc") == "fail").alias("dmarc_bad"),
        F.count_distinct("classification").alias("n_classes"),
    )
    used = used_indicators(rows, members).groupBy("campaign_id").agg(*(count(F.col("kind") == k).alias(f"n_{k}") for k in ("ip", "domain", "url", "hash")))
    return base.join(used, "campaign_id", "left").fillna(0, [f"n_{k}" for k in ("ip", "domain", "url", "hash")])


def _first_shared(key: str) -> Column:
    """Whether the word of the join's key is the first one that both sides share, so that a pair counts once."""
    return F.substring_index(F.col("key_x"), "\n", -1) == F.array_min(F.array_intersect(f"{key}_x", f"{key}_y"))


def _by_word(rows: DataFrame, words: str) -> DataFrame:
    """A row per word, keyed by campaign and word."""
    return rows.select("*", F.explode(words).alias("word")).withColumn("key", F.concat_ws("\n", "campaign_id", "word")).drop("word")


def subject_likeness(rows: DataFrame, members: DataFrame, hot: int = 256) -> DataFrame:
    """campaign_id, number of non-blank subjects n, mean Jaccard of all their pairs; equal subjects are counted, not paired.

    Words that over ``hot`` subjects of a campaign share never make pairs of
    subjects: subjects are grouped by their hot words and size, and pairs of groups
    give what all pairs have by hot words alone.  Pairs that share another word are
    found under it, at most ``hot`` subjects at a time, and add the difference.
    """
    joined = rows.join(members.select("email_id", "campaign_id"), "email_id").filter(F.size(_subject_words(F.col("subject"))) > 0)
    subjects = joined.groupBy("campaign_id", F.array_sort(_subject_words(F.col("subject"))).alias("words")).agg(F.count("*").cast("double").alias("m"))
    subjects = written(subjects.withColumns({"sid": F.md5(F.array_join("words", "\n")), "n": F.size("words")}), "subjects")
    own = subjects.groupBy("campaign_id").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"))
    each = subjects.select("campaign_id", "sid", F.explode("words").alias("word"))
    counts = each.groupBy("campaign_id", "word").agg(F.count("*").alias("size")).withColumn("key", F.concat_ws("\n", "campaign_id", "word"))
    often = attach(each.withColumn("key", F.concat_ws("\n", "campaign_id", "word")), counts.filter(F.col("size") > hot).select("key", "size"), "key", "size", F.col("sid"))
    often = often.groupBy("campaign_id", "sid").agg(F.array_sort(F.collect_list("word")).alias("hot"))
    subjects = written(subjects.join(often, ["campaign_id", "sid"], "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<string>"))), "subjects-hot")
    size = lambda a, b: F.size(F.array_intersect(a, b))
    like = lambda shared: shared / (F.col("n_x") + F.col("n_y") - shared)
    groups = subjects.filter(F.size("hot") > 0).groupBy("campaign_id", "hot", "n").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("squares"))
    groups = written(groups.withColumn("gid", F.md5(F.concat_ws("\n", F.col("n").cast("string"), "hot"))), "subject-groups")
    inner = groups.select("campaign_id", ((F.col("m") * F.col("m") - F.col("squares")) / 2 * F.size("hot") / (2 * F.col("n") - F.size("hot"))).alias("part"))
    left, right, meet = pair_chunks(_by_word(groups, "hot").drop("squares"), "key", "gid", CHUNK)
    outer = left.join(right, meet).filter(_first_shared("hot")).select(F.col("campaign_id_x").alias("campaign_id"), (F.col("m_x") * F.col("m_y") * like(size("hot_x", "hot_y"))).alias("part"))
    cold = subjects.withColumn("cold", F.array_except("words", "hot"))
    left, right, meet = pair_chunks(_by_word(cold, "cold"), "key", "sid", CHUNK)
    more = like(size("words_x", "words_y")) - like(size("hot_x", "hot_y"))
    rest = left.join(right, meet).filter(_first_shared("cold")).select(F.col("campaign_id_x").alias("campaign_id"), (F.col("m_x") * F.col("m_y") * more).alias("part"))
    crossed = inner.unionByName(outer).unionByName(rest).groupBy("campaign_id").agg(F.sum("part").alias("crossed"))
    mean = (F.col("same") + F.coalesce("crossed", F.lit(0.0))) / (F.col("n") * (F.col("n") - 1) / 2)
    return own.join(crossed, "campaign_id", "left").select("campaign_id", F.col("n").alias("n_subjects"), F.when(F.col("n") > 1, mean).otherwise(0.0).alias("likeness"))


def confidence(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The four scores, the weighted confidence and its level for each campaign."""
    t = telemetry(rows, members).join(subject_likeness(rows, members), "campaign_id", "left")
    many = F.col("n_emails") >= 2
    extra = lambda c, step, most: F.least(F.lit(most), F.col(c) * step)
    infra = F.least(F.lit(1.0), F.lit(0.2) + F.when(many, extra("n_ip", 0.18, 0.35) + extra("n_domain", 0.15, 0.30) + extra("n_url", 0.15, 0.25) + extra("n_hash", 0.15, 0.20)).otherwise(0.0))
    h = F.col("span_hours")
    temporal = F.when(~many, 0.3).when(F.col("n_times") < 2, 0.4).when(h <= 2, 0.95).when(h <= 24, 0.85).when(h <= 72, 0.65).otherwise(0.40)
    n = F.col("n_emails")
    failing = F.when((F.col("spf_bad") == n) | (F.col("dmarc_bad") == n), 0.35).when(F.col("spf_bad") > 0, 0.2).otherwise(0.0)
    behaviour = F.when(~many, 0.3).otherwise(F.least(F.lit(1.0), F.lit(0.5) + failing + F.when(F.col("n_classes") == 1, 0.15).otherwise(0.0)))
    content = F.when(F.coalesce("n_subjects", F.lit(0.0)) < 2, 0.3).when(F.col("likeness") >= 0.7, 0.90).when(F.col("likeness") >= 0.4, 0.65).otherwise(0.35)
    parts = {"infrastructure": infra, "temporal": temporal, "behaviour": behaviour, "content": content}
    out = t.select("campaign_id", "n_emails", *(c.alias(k) for k, c in parts.items()))
    total = sum((F.col(k) * w for k, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    level = F.when(F.col("confidence") >= 0.9, "very_high").when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")
    return out.withColumn("confidence", total).withColumn("level", level)


def evidence(rows: DataFrame, members: DataFrame) -> DataFrame:
    """What speaks for a campaign and what limits that: campaign_id, evidence, limitations."""
    t = telemetry(rows, members)
    n = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))
    found = (n("n_ip", "shared addresses"), n("n_domain", "shared domains"), n("n_url", "shared links"), n("n_hash", "shared payloads"), F.when(F.col("span_hours") <= 24, "sent within a day"), F.when(F.col("n_classes") == 1, "one classification"), n("spf_bad", "failing SPF"), n("dmarc_bad", "failing DMARC"))
    limits = (F.when(F.col("n_emails") < 3, "few emails"), F.when(F.col("n_times") < 2, "few times known"), F.when(F.col("n_ip") + F.col("n_hash") == 0, "no shared address or payload"), F.lit("shared infrastructure is no proof of a common author"))
    return t.select("campaign_id", F.array_compact(F.array(*found)).alias("evidence"), F.array_compact(F.array(*limits)).alias("limitations"))


def report(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Campaign details with their confidence."""
    rated = confidence(rows, members).withColumnsRenamed({"confidence": "attribution"}).drop("n_emails")
    return details(campaigns(rows, members)).join(rated, "campaign_id")


