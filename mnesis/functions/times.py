"""French time and age labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of days and months, and the hours at which a period of the day ends.
DAYS = ["lun", "mar", "mer", "jeu", "ven", "sam", "dim"]
MONTHS = ["jan", "fév", "mar", "avr", "mai", "jun", "jul", "aoû", "sep", "oct", "nov", "déc"]
PERIODS = [(6, "Nuit"), (12, "Matin"), (14, "Midi"), (18, "Après-midi"), (22, "Soirée"), (25, "Nuit")]


def _name(names: list[str], one_based: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), one_based.cast("int"))


def period_of_day(hour: Column) -> Column:
    out = F.when(hour < PERIODS[0][0], PERIODS[0][1])
    for end, name in PERIODS[1:]:
        out = out.when(hour < end, name)
    return out


def time_label(start: Column, end: Column) -> Column:
    hours = F.timestamp_diff("SECOND", start, end) / 3600.0
    day, month = _name(DAYS, F.weekday(start) + 1), _name(MONTHS, F.month(start))
    d1, d2 = F.dayofmonth(start).cast("string"), F.dayofmonth(end).cast("string")
    return (
        F.when(start.isNull() | end.isNull(), "date inconnue")
        .when(hours < 0.1, F.concat(day, F.lit(" "), d1, F.lit(" "), month, F.lit(" à "), F.lpad(F.hour(start).cast("string"), 2, "0"), F.lit("h"), F.lpad(F.minute(start).cast("string"), 2, "0")))
        .when(hours < 24, F.concat(period_of_day(F.hour(start)), F.lit(" du "), day, F.lit(" "), d1, F.lit(" "), month))
        .when(hours < 48, F.concat(day, F.lit(" "), d1, F.lit("–"), d2, F.lit(" "), month))
        .when(F.month(start) == F.month(end), F.concat(d1, F.lit("–"), d2, F.lit(" "), month))
        .otherwise(F.concat(d1, F.lit(" "), month, F.lit(" – "), d2, F.lit(" "), _name(MONTHS, F.month(end))))
    )


def age_label(days: Column) -> Column:
    n = lambda unit: F.floor(days / unit).cast("string")
    return (
        F.when(days < 1, "aujourd'hui").when(days < 2, "hier").when(days < 7, F.concat(F.lit("il y a "), n(1), F.lit(" jours")))
        .when(days < 30, F.concat(F.lit("il y a "), n(7), F.lit(" semaines"))).when(days < 365, F.concat(F.lit("il y a "), n(30), F.lit(" mois")))
        .when(days.isNotNull(), F.concat(F.lit("il y a "), n(365), F.lit(" ans")))
    )
