"""Mixed timestamp notations and zones to instants in UTC (problem 7)."""

from __future__ import annotations

import datetime as dt
import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years whose intervals are listed. All zones have one offset before; after, they follow fixed rules, which the last 28
#: listed years show for every kind of year (first weekday, leap year or not).
FIRST_YEAR, LAST_YEAR = 1800, 2128

# Month names of the notations (English and French by their first letters, others in full),
# without accents.
MONTHS = {
    1: ["jan", "january", "janv", "janvier", "januar", "enero", "ene", "gennaio", "gen", "janeiro", "januari", "janner"],
    2: ["feb", "february", "fevr", "fev", "fevrier", "februar", "febrero", "febbraio", "fevereiro", "februari"],
    3: ["mar", "march", "mars", "marz", "marzo", "marco", "maart", "mrt"],
    4: ["apr", "april", "avr", "avril", "abr", "abril", "aprile"],
    5: ["may", "mai", "mayo", "maggio", "mag", "maio", "mei"],
    6: ["jun", "june", "juin", "juni", "junio", "giugno", "giu", "junho"],
    7: ["jul", "july", "juil", "juillet", "juli", "julio", "luglio", "lug", "julho"],
    8: ["aug", "august", "aout", "ago", "agosto", "augustus"],
    9: ["sep", "sept", "september", "septembre", "septiembre", "settembre", "set", "setembro"],
    10: ["oct", "october", "octobre", "okt", "oktober", "octubre", "ottobre", "ott", "out", "outubro"],
    11: ["nov", "november", "novembre", "noviembre", "novembro"],
    12: ["dec", "december", "decembre", "dez", "dezember", "dic", "diciembre", "dicembre", "dezembro"],
}
# Zone abbreviations and their offsets in seconds.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200, "mez": 3600, "mesz": 7200,
    "eet": 7200, "eest": 10800, "msk": 10800, "wat": 3600, "ist": 19800, "npt": 20700, "jst": 32400, "aest": 36000, "aedt": 39600,
    "nst": -12600, "ndt": -9000, "ast": -14400, "adt": -10800, "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000,
    "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200,
}


def _zone_rows(zones: pd.Series) -> pd.DataFrame:
    utc, step = dt.timezone.utc, dt.timedelta(days=21)
    first, last = dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc), dt.datetime(LAST_YEAR, 12, 31, tzinfo=utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=utc)
    seconds = lambda t: int((t - epoch).total_seconds())
    out = []
    for name in zones:
        zone = zoneinfo.ZoneInfo(name)
        offset = lambda t: int(t.astimezone(zone).utcoffset().total_seconds())  # noqa: B023, E731
        at, now = first, offset(first)
        spans = [(-(10**12), now)]
        while at < last:
            after = at + step
            then = offset(after)
            if then != now:
                lo, hi = seconds(at), seconds(after)
                while hi - lo > 1:  # the second at which the offset changes
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(epoch + dt.timedelta(seconds=mid)) == now else (lo, mid)
                spans.append((hi, then))
            at, now = after, then
        for i, (start, off) in enumerate(spans):
            end = spans[i + 1][0] if i + 1 < len(spans) else 10**12
            local_start, own_end = start + off, end + off
            next_start = end + spans[i + 1][1] if i + 1 < len(spans) else 10**12
            before, before_end = (spans[i - 1][1], start + spans[i - 1][1]) if i else (off, -(10**12))
            lo_year = max(FIRST_YEAR, 1970 + local_start // 31556952 - 1) if i else FIRST_YEAR
            hi_year = min(LAST_YEAR, 1970 + next_start // 31556952 + 1) if i + 1 < len(spans) else LAST_YEAR
            for year in range(int(lo_year), int(hi_year) + 1):
                lo_s = seconds(dt.datetime(year, 1, 1, tzinfo=utc))
                hi_s = seconds(dt.datetime(year, 12, 31, 23, 59, 59, tzinfo=utc))
                if local_start <= hi_s and next_start > lo_s:
                    out.append((name.lower(), year, local_start, next_start, own_end, off, before, before_end))
    return pd.DataFrame(out, columns=["zone", "year", "asof_from", "asof_to", "own_end", "off_s", "prev_off_s", "prev_end"])


def zone_intervals(spark: SparkSession, zones: DataFrame | None = None) -> DataFrame:
    """Offset intervals of IANA zones in local seconds, one row per zone and year they touch.

    ``zones``: ``zone``, the names that occur in any case and with repetitions; all zones without it.
    ``asof_from <= local < asof_to`` selects the as-of row of a wall-clock reading. The reading lies
    in the row's own interval when it is below ``own_end``, and also in the one before when it is
    below ``prev_end``. The size is bounded by the zone database (about 600 zones and 330 years),
    whatever ``zones`` holds.
    """
    names = {x.lower(): x for x in sorted(zoneinfo.available_timezones() - {"localtime", "posixrules"})}
    schema = "zone string, year int, asof_from bigint, asof_to bigint, own_end bigint, off_s int, prev_off_s int, prev_end bigint"
    if zones is None:
        zones = spark.createDataFrame([(x,) for x in names], "zone string")
    source = zones.select(F.lower(F.trim("zone")).alias("zone")).where(F.col("zone").isin(*names)).distinct().repartition(max(2, spark.sparkContext.defaultParallelism))
    return source.mapInPandas(lambda it: (_zone_rows(p["zone"].map(names)) for p in it), schema)


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def parse_readings(records: DataFrame, raw: str, date_order: Column, default_zone: Column) -> DataFrame:
    """Adds ``_local_s`` (wall clock or epoch seconds), ``_frac_us``, ``_off_s`` and ``_zone`` to ``records``.

    All of it is built-in expressions: one regular expression per notation of the date, one for
    clock and zone. Values that are no valid date and time get a null ``_local_s``.
    """
    s = F.lower(F.regexp_replace(F.col(raw), r"[​-‏⁠﻿‪-‮]", ""))
    s = F.trim(F.regexp_replace(s, r"[\s   ]+", " "))
    s = F.trim(F.regexp_replace(s, r"^[\[(\"'](.*)[\])\"']$", "$1"))
    s = F.translate(s, "áàâäéèêëíîïóôöúûüç", "aaaaeeeeiiiooouuuc")
    df = records.withColumn("_s", s)
    S = F.col("_s")
    ymd = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
    num = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"
    mdy = r"^(?:[a-z]{2,10}\.?,? )?([a-z]{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?!\d)"
    dmy = r"^(?:[a-z]{2,10}\.?,? )?(?:le )?(\d{1,2})(?:\.|er|st|nd|rd|th)?[ -](?:de )?([a-z]{3,10})\.?,?[ -](?:de )?(\d{4}|\d{2})(?!\d)"
    tight = r"^(\d{4})(\d{2})(\d{2})(?=$|[t ]\d|\d{6}(?!\d)|\d{4}(?!\d))"
    epoch = r"^([+-]?\d{1,19})(?:[.,](\d+))?$"
    digits = F.length(F.regexp_extract(S, r"^[+-]?(\d+)", 1))
    is_epoch = S.rlike(epoch) & ~digits.isin(8, 12, 14)
    kind = (
        F.when(S.isNull() | (S == ""), F.lit(None))
        .when(is_epoch & (digits >= 9), "epoch")
        .when(S.rlike(ymd), "ymd").when(S.rlike(num), "num").when(S.rlike(tight), "tight").when(S.rlike(dmy), "dmy").when(S.rlike(mdy), "mdy")
    )
    df = df.withColumn("_kind", kind)
    K = F.col("_kind")

    def pick(ymd_group: int, num_group: int, tight_group: int, dmy_group: int, mdy_group: int) -> Column:
        return (
            F.when(K == "ymd", F.regexp_extract(S, ymd, ymd_group)).when(K == "num", F.regexp_extract(S, num, num_group))
            .when(K == "tight", F.regexp_extract(S, tight, tight_group)).when(K == "dmy", F.regexp_extract(S, dmy, dmy_group))
            .when(K == "mdy", F.regexp_extract(S, mdy, mdy_group))
        )

    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in names for x in (name, str(n))])
    df = df.withColumns({"_y": pick(1, 3, 1, 3, 3), "_a": pick(2, 1, 2, 2, 1), "_b": pick(3, 2, 3, 1, 2)})
    named = K.isin("dmy", "mdy")
    month_first = ~((K == "num") & (F.coalesce(date_order, F.lit("dmy")) != "mdy"))
    a, b = F.col("_a"), F.col("_b")
    df = df.withColumns({
        "_year": F.when(F.length("_y") == 2, _int(F.col("_y")) + 2000).otherwise(_int(F.col("_y"))),
        "_month": _int(F.when(named, F.element_at(months, a)).when(month_first, a).otherwise(b)),
        "_day": _int(F.when(named | month_first, b).otherwise(a)),
        "_rest": F.when(K == "ymd", F.regexp_replace(S, ymd, "")).when(K == "num", F.regexp_replace(S, num, ""))
        .when(K == "tight", F.regexp_replace(S, tight, "")).when(K == "dmy", F.regexp_replace(S, dmy, "")).when(K == "mdy", F.regexp_replace(S, mdy, "")),
    })
    zone_re = r"(z|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}|\[?[a-z]+(?:/[a-z0-9_+-]+)+\]?)?$"
    clock = (
        r"^(?:t|,? ?(?:a|at|um|as|alle|om|a las|kl\.?)? ?)(\d{1,2})(?: ?[:h.] ?(\d{2}))(?:[:.](\d{2})(?:[.,](\d+))?)? ?(?:(am|pm|a\.m\.?|p\.m\.?|a\. m\.|p\. m\.)(?![a-z]))? ?"
        + zone_re
    )
    clock_tight = r"^[t ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()\s?" + zone_re
    clock_hour = r"^(?:t|,? ?(?:a|at|um)? ?)(\d{1,2})()()() ?(am|pm|a\.m\.?|p\.m\.?|h|uhr)(?![a-z]) ?" + zone_re
    R = F.col("_rest")
    form = F.when(R.rlike(clock), 1).when((K == "tight") & R.rlike(clock_tight), 2).when(R.rlike(clock_hour), 3).when(R == "", 4)
    df = df.withColumn("_form", form)
    C = F.col("_form")
    g = lambda i: F.when(C == 1, F.regexp_extract(R, clock, i)).when(C == 2, F.regexp_extract(R, clock_tight, i)).when(C == 3, F.regexp_extract(R, clock_hour, i)).otherwise("")
    df = df.withColumns({"_h": g(1), "_mi": g(2), "_se": g(3), "_fr": g(4), "_ap": F.substring(g(5), 1, 1), "_zo": F.regexp_replace(g(6), r"[\[\]]", "")})
    half = F.col("_ap").isin("a", "p")
    h = F.coalesce(_int(F.col("_h")), F.lit(0))
    mi, se = F.coalesce(_int(F.col("_mi")), F.lit(0)), F.coalesce(_int(F.col("_se")), F.lit(0))
    hour = F.when(half, h % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0)).otherwise(h)
    y, m, d = F.col("_year"), F.col("_month"), F.col("_day")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    month_days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = (
        y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= month_days) & C.isNotNull()
        & (mi < 60) & (se < 60) & F.when(half, h.between(1, 12)).otherwise(h < 24)
    )
    first = F.make_date(F.when(y.between(1, 9999), y).otherwise(1970), F.when(m.between(1, 12), m).otherwise(1), F.lit(1))
    local_s = (F.unix_date(first) + d - 1).cast("bigint") * 86400 + hour * 3600 + mi * 60 + se
    # epochs: up to 11 digits seconds, 13 milli-, 16 micro-, 19 nanoseconds
    whole = F.regexp_extract(S, epoch, 1).try_cast("decimal(20,0)")
    unit = F.when(digits <= 11, 1_000_000).when(digits <= 13, 1000).otherwise(1)
    fraction_us = lambda text: F.rpad(F.substring(text, 1, 6), 6, "0").try_cast("bigint")
    epoch_us = (
        F.when(digits > 16, F.floor(whole / 1000).cast("bigint")).otherwise((whole * unit).try_cast("bigint"))
        + F.when((digits <= 11) & (F.regexp_extract(S, epoch, 2) != ""), fraction_us(F.regexp_extract(S, epoch, 2))).otherwise(0)
    )
    zo = F.col("_zo")
    numeric = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract(zo, numeric, 1) == "-", -1).otherwise(1)
    numeric_s = sign * (_int(F.regexp_extract(zo, numeric, 2)) * 3600 + F.coalesce(_int(F.regexp_extract(zo, numeric, 3)), F.lit(0)) * 60)
    short = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    offset = F.when(zo.rlike(numeric), numeric_s).otherwise(F.element_at(short, zo))
    # a word where a zone could stand that is none makes the value no time
    readable = (zo == "") | offset.isNotNull() | zo.contains("/")
    is_e = K == "epoch"
    # Always true, but no predicate moves below it: a filter on the result would otherwise be
    # rewritten in terms of the raw text, with every expression above expanded in place.
    barrier = F.spark_partition_id() >= 0
    out = {
        "_local_s": F.when(is_e & barrier, F.floor(epoch_us / 1_000_000).cast("bigint")).when(K.isNotNull() & valid & readable & barrier, local_s),
        "_frac_us": F.when(is_e, F.pmod(epoch_us, F.lit(1_000_000))).when(F.col("_fr") != "", fraction_us(F.col("_fr"))).otherwise(0),
        "_off_s": F.when(is_e, 0).when(zo != "", offset),
        "_zone": F.when(is_e, None).when(zo.contains("/"), zo).when(zo == "", F.lower(F.trim(default_zone))),
        "_read_year": F.when(is_e, None).otherwise(y),
    }
    df = df.withColumns(out)
    return df.drop("_s", "_kind", "_y", "_a", "_b", "_year", "_month", "_day", "_rest", "_form", "_h", "_mi", "_se", "_fr", "_ap", "_zo")


def resolve_instants(parsed: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join of wall-clock readings to zone-offset intervals: adds ``utc_us`` and ``n_intervals``.

    Each reading meets the one interval that began last before it. Two intervals holding the
    reading mean it is ambiguous and the first instant (the earlier offset) counts; none means it
    was skipped and is read with the offset before the change; one gives the offset directly.
    """
    z = F.broadcast(intervals)  # bounded by the zone database
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    kind = lambda y: F.dayofweek(F.make_date(y, F.lit(1), F.lit(1))) * 2 + leap(y).cast("int")
    alike = {dt.date(y, 1, 1).isoweekday() % 7 * 2 + 2 + (y % 4 == 0): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    year = F.col("_read_year")
    late = F.element_at(F.create_map(*[F.lit(int(x)) for pair in alike.items() for x in pair]), kind(F.greatest(year, F.lit(1))))
    shown = F.when(year > LAST_YEAR, late).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))
    days = F.date_diff(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(1)), F.make_date(shown, F.lit(1), F.lit(1)))
    parsed = parsed.withColumns({"_shown_year": shown, "_at": F.col("_local_s") - F.when(year > LAST_YEAR, days.cast("bigint") * 86400).otherwise(0)})
    on = (F.col("_zone") == z["zone"]) & (F.col("_shown_year") == z["year"]) & (F.col("_at") >= z["asof_from"]) & (F.col("_at") < z["asof_to"])
    joined = parsed.join(z, on, "left")
    n = (F.col("_at") < F.col("prev_end")).cast("int") + (F.col("_at") < F.col("own_end")).cast("int")
    offset = F.coalesce("_off_s", F.when(F.col("_at") < F.col("prev_end"), F.col("prev_off_s")).otherwise(F.col("off_s")))
    kept = [c for c in parsed.columns if not c.startswith("_")]
    return joined.select(
        *[parsed[c] for c in kept],
        ((F.col("_local_s") - offset) * 1_000_000 + F.col("_frac_us")).alias("utc_us"),
        F.when(F.col("_off_s").isNull(), n).alias("n_intervals"),
    )


def normalise_timestamps(records: DataFrame, channels: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """``record_id, utc_us, n_intervals`` for every record whose ``timestamp_raw`` is a valid time.

    A zone or offset in the value prevails, then ``export_zone``, then the channel's ``home_zone``.
    Null, blank and unreadable values, impossible dates and readings whose zone is unknown yield no
    row. Records of a channel that is not listed are read day first and need a zone of their own.
    Repeated records give repeated rows; other columns are dropped before any join.
    """
    c = channels.select(F.lower(F.trim("channel")).alias("_channel"), F.col("home_zone").alias("_home"), F.col("date_order").alias("_order"))
    rows = records.select("record_id", "timestamp_raw", F.col("export_zone").alias("_export"), F.lower(F.trim("channel")).alias("_channel"))
    rows = rows.join(c, "_channel", "left")
    zone = F.coalesce(F.when(F.trim("_export") != "", F.col("_export")), F.col("_home"))
    parsed = parse_readings(rows, "timestamp_raw", F.col("_order"), zone).where("_local_s is not null")
    parsed = parsed.select("record_id", "_local_s", "_frac_us", "_off_s", "_zone", "_read_year")
    if intervals is None:  # only of the zones that occur
        written = F.regexp_extract("timestamp_raw", r"([A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)", 1)
        occurring = records.select(F.explode(F.array("export_zone", written)).alias("zone")).distinct().unionByName(channels.select(F.col("home_zone").alias("zone")))
        intervals = zone_intervals(records.sparkSession, occurring)
    return resolve_instants(parsed, intervals).where("utc_us is not null")
