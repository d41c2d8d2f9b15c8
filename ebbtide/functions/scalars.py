"""Per-row derivations. Each takes and returns Columns, so it stays in codegen."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig

# Size-class bounds (exclusive upper limits).
TIER_BOUNDS = ((10_000, "micro"), (500_000, "mid"))
# Disclosure bands, wide enough not to name an account.
DISCLOSURE_BANDS = (
    (1e4, "under 10k"), (1e5, "10k-100k"), (5e5, "100k-500k"), (5e6, "500k-5M"),
)
# Comparison bands on log10 of the follower count.
REFERENCE_BANDS = ((4.0, "under 10,000"), (6.0, "10,000 to 1 million"))
# Hosts and path kinds that carry an 11-character video id.
VIDEO_HOSTS = (
    "youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com",
    "youtu.be", "www.youtu.be", "youtube-nocookie.com", "www.youtube-nocookie.com",
)
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
VIDEO_PATHS = ("shorts", "live", "embed", "v", "e")
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"

MICROS_PER_HOUR = 3.6e9


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ladder(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """CASE WHEN in the given order."""
    first, *rest = cases
    out = F.when(first[0], first[1])
    for cond, val in rest:
        out = out.when(cond, val)
    return out.otherwise(default)


def finite(x: Column | str) -> Column:
    """Null for null, NaN and infinities; the value otherwise."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def canonical_id(x: Column | str) -> Column:
    """Identifiers are text; an integral number loses its trailing `.0`."""
    return F.regexp_replace(c(x).cast("string"), r"^(-?\d+)\.0$", "$1")


def parse_utc(x: Column | str) -> Column:
    """UTC timestamp from ISO text; null where it cannot be read."""
    return F.try_to_timestamp(F.nullif(F.trim(c(x).cast("string")), F.lit("")))


def iso_duration_seconds(x: Column | str) -> Column:
    """`PT1H2M3S` in seconds. Other forms and a zero length are null."""
    whole = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
    part = lambda i: F.coalesce(F.regexp_extract(c(x), whole, i).try_cast("double"), F.lit(0.0))
    total = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(c(x).rlike(whole), F.nullif(total, F.lit(0.0)))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Hours from `start` to `end`, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", c(start), c(end)) / F.lit(MICROS_PER_HOUR)


def age_hours(reading_ts: Column | str, published_at: Column | str,
              collected: Column | str | None = None) -> Column:
    """Age recomputed from the two timestamps; the collected age where one is missing."""
    fallback = F.lit(None).cast("double") if collected is None else c(collected).cast("double")
    return F.coalesce(hours_between(published_at, reading_ts), fallback)


def primary_metric(source: Column | str, metric: Mapping[str, str]) -> Column:
    """Name of the counter that stands for engagement on each source."""
    return ladder([(c(source) == s, F.lit(m)) for s, m in metric.items()], F.lit(None).cast("string"))


def primary_value(source: Column | str, metric: Mapping[str, str]) -> Column:
    return ladder([(c(source) == s, F.col(m)) for s, m in metric.items()], F.lit(None))


def tier_of(size: Column | str) -> Column:
    """micro / mid / large; a hidden size is `unknown`, never guessed."""
    cases = [(c(size).isNull(), F.lit("unknown"))]
    cases += [(c(size) < b, F.lit(n)) for b, n in TIER_BOUNDS]
    return ladder(cases, F.lit("large"))


def reference_band(log_size: Column | str) -> Column:
    cases = [(finite(log_size).isNull(), F.lit(None).cast("string"))]
    cases += [(c(log_size) < b, F.lit(n)) for b, n in REFERENCE_BANDS]
    return ladder(cases, F.lit("over 1 million"))


def disclosure_band(size: Column | str) -> Column:
    cases = [(finite(size).isNull(), F.lit("unknown size"))]
    cases += [(c(size) < b, F.lit(n)) for b, n in DISCLOSURE_BANDS]
    return ladder(cases, F.lit("over 5M"))


def round_sig2(x: Column | str) -> Column:
    """Two significant figures; below 100 to a whole number; negatives become 0."""
    v = F.greatest(finite(x), F.lit(0.0))
    mag = F.pow(F.lit(10.0), F.floor(F.log10(v)) - 1)
    big = F.bround(v / mag) * mag
    return F.when(finite(x).isNull(), F.lit(None)).otherwise(
        F.when(v < 100, F.bround(v)).otherwise(big)).cast("bigint")


def log10_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log_ratio(later: Column, earlier: Column) -> Column:
    """log10(later / earlier) without smoothing; null where the base is not positive."""
    return F.when((earlier > 0) & (later >= 0), F.log10(F.nullif(later / earlier, F.lit(0.0))))


def instant_features(age="age_hours", views="views", likes="likes", comments="comments",
                     subscribers="follower_count", duration="duration_sec",
                     publish_hour="publish_hour_utc", title_len="title_len") -> dict[str, Column]:
    """The ten inputs known from one reading. One builder for training and scoring.

    Missing stays null. Logs are rounded to two decimals so that the table
    cannot be used to look up exact counts. Rows must satisfy `instant_valid`.
    """
    v, a = c(views).cast("double"), c(age).cast("double")
    subs, dur = finite(subscribers), finite(duration)
    per_view = lambda n, floor: F.when(v > 0, F.log10(F.greatest(finite(n) / v, F.lit(floor))))
    r2 = lambda x: F.bround(x, 2)
    # Floors (fixed values): a rate of zero reads as 1e-5 likes or 1e-6 comments per view.
    # greatest() skips nulls, so a missing counter is screened first.
    rate = lambda n, floor: F.when(finite(n).isNotNull(), per_view(n, floor))
    return {
        "age_h": r2(a),
        "log_views": r2(F.log10(v + 1)),
        "log_views_per_h": r2(F.log10(v / a + 1)),
        "log_like_rate": r2(rate(likes, 1e-5)),
        "log_comment_rate": r2(rate(comments, 1e-6)),
        "log_views_per_sub": r2(F.when(subs > 0, F.log10((v + 1) / subs))),
        "log_subscribers": r2(F.when(subs > 0, F.log10(subs + 1))),
        "log_duration_sec": r2(F.when(dur > 0, F.log10(dur + 1))),
        "publish_hour_utc": c(publish_hour).cast("double"),
        "title_len": c(title_len).cast("double"),
    }


def instant_valid(age="age_hours", views="views") -> Column:
    """True where one reading can be turned into inputs at all."""
    return F.coalesce((finite(age) > 0) & (finite(views) >= 0), F.lit(False))


def mark_of(age: Column | str, cfg: PanelConfig = PanelConfig(), first: bool = True) -> Column:
    """The scheduled mark a reading belongs to, or null.

    Where windows overlap, a single lookup answers the first mark (`first`) and
    the training table keeps the last.
    """
    marks = cfg.marks if first else tuple(reversed(cfg.marks))
    inside = lambda m: c(age).between(m - cfg.tolerance, m + cfg.late_tolerance)
    return ladder([(inside(m), F.lit(float(m))) for m in marks], F.lit(None).cast("double"))


def nearest_checkpoint(age: Column | str, cfg: PanelConfig = PanelConfig()) -> Column:
    """Closest checkpoint on a log scale; an exact tie goes to the earlier one."""
    gaps = [F.struct(F.abs(F.ln(c(age) / F.lit(m))).alias("gap"), F.lit(m).alias("mark"))
            for m in cfg.checkpoints]
    return F.when(c(age) > 0, F.least(*gaps)["mark"])


def fade_mark(t: Column | str, cfg: PanelConfig = PanelConfig()) -> Column:
    """Largest mark at most one tolerance past `t`, never below the first mark."""
    cases = [(F.lit(float(m)) <= c(t) + cfg.tolerance, F.lit(float(m))) for m in reversed(cfg.marks)]
    return F.when(c(t).isNotNull(), ladder(cases, F.lit(float(cfg.marks[0]))))


def owner_fold(owner: Column | str, n: int = 5) -> Column:
    """A fixed split of owners into `n` groups.

    For 5 groups it is the SHA-256 value modulo 5: every power of 16 leaves
    remainder 1, so the hex digits' sum has the same remainder.
    """
    if n != 5:
        return F.pmod(F.xxhash64(c(owner).cast("string")), F.lit(n)).cast("int")
    digest = F.sha2(c(owner).cast("string"), 256)
    digits = F.transform(F.split(digest, ""), lambda d: F.conv(d, 16, 10).try_cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return (total % 5).cast("int")


def cohort_of(published_at: Column | str, bounds: Sequence[tuple[str, str]], rest: str = "later") -> Column:
    """Name of the first half-open interval whose end lies after `published_at`."""
    return ladder([(c(published_at) < F.lit(end).cast("timestamp"), F.lit(name)) for name, end in bounds],
                  F.lit(rest))


def publish_calendar(published_at: Column | str) -> dict[str, Column]:
    day = F.weekday(c(published_at))
    return {"publish_hour_utc": F.hour(c(published_at)),
            "publish_weekday": day,
            "publish_is_weekend": (day >= 5).cast("int")}


def redact(text: Column | str, secrets: Sequence[str] = ()) -> Column:
    """Blank `key=` parameters and the named secrets."""
    out = F.regexp_replace(c(text), r"([?&]key=)[^&\s\"'#]+", "$1REDACTED")
    return reduce(lambda s, k: F.replace(s, F.lit(k), F.lit("REDACTED")), [k for k in secrets if k], out)


def video_id(link: Column | str) -> Column:
    """The 11-character id in a video link, or a bare id; null otherwise."""
    s = F.trim(c(link))
    url = F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    candidate = ladder([
        (host.isin(*SHORT_HOSTS), first),
        (first == "watch", F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)),
        (first.isin(*VIDEO_PATHS), second),
    ])
    found = F.when(host.isin(*VIDEO_HOSTS) & candidate.rlike(VIDEO_ID), candidate)
    return F.when(s.rlike(VIDEO_ID), s).otherwise(found)


def risk_band(p: Column | str, high: float, low: float) -> Column:
    return ladder([(c(p).isNull(), F.lit(None).cast("string")),
                   (c(p) >= high, F.lit("high")), (c(p) <= low, F.lit("low"))], F.lit("typical"))


def report_state(age: Column | str, views: Column | str, live: Column | str | None = None,
                 cfg: PanelConfig = PanelConfig()) -> dict[str, Column]:
    """What can be said about an entity of this age, and the wait until odds are possible."""
    is_live = F.lit(False) if live is None else F.coalesce(c(live).isin("live", "upcoming"), F.lit(False))
    state = ladder([
        (is_live | (c(age) <= 0), F.lit("live")),
        (c(views).isNull(), F.lit("no_numbers")),
        (c(age) > cfg.marks[-1] + cfg.late_tolerance, F.lit("beyond_window")),
        (c(age) < cfg.min_odds_age, F.lit("too_new")),
        (c(age) > cfg.max_odds_age, F.lit("too_old_for_odds")),
    ], F.lit("ok"))
    wait = F.when(state == "too_new", F.ceil((F.lit(cfg.min_odds_age) - c(age)) * 60)).cast("bigint")
    return {"state": state, "minutes_until_ready": wait}


def life_status(event: Column | str, t_death: Column | str, last_age: Column | str,
                reason: Column | str) -> Column:
    """excluded / died at / still alive at, as one categorical text."""
    return ladder([
        (c(reason).isNotNull(), F.lit("not enough observations")),
        (c(event), F.format_string("died at %.1fh", c(t_death))),
    ], F.format_string("alive at %.1fh", c(last_age)))


def add(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(cols))
