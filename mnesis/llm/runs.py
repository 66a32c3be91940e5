"""Repeated consecutive events in ordered sequences (problem 1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.shared import materialise
from mnesis.tables import micros

_INVISIBLE = re.compile("[​-‏⁠﻿­‪-‮️]")
# Trifles around a repeated report: reply marks, a clock reading, a number of the attempt, an edit mark.
_LEAD = re.compile(r"^(?:\s+|>+|(?:re|fw|fwd|aw|wg|tr|rv|sv|antw)\s*:|[\[(]\s*\d{1,2}\s*[:h.]\s*\d{2}(?:[:.]\d{2})?\s*(?:am|pm)?\s*[\])]|\d{1,2}[:h]\d{2}(?::\d{2})?\s*[-–:]|[*•–-]\s)")
_TAIL = re.compile(
    r"(?:\s+|[!?.…,;:~*]+|\((?:edited|modifie|editado|bearbeitet|bewerkt|modificato|изменено)\)"
    r"|[\[(]?\b(?:attempt|try|retry|essai|tentative|versuch|intento|tentativo|tentativa|poging|попытка|no|nr|n)\b\.?\s*#?\d+(?:\s*/\s*\d+)?[\])]?"
    r"|[\[(]\s*(?:x\s*)?\d+\s*(?:x|times|fois|mal|veces|/\s*\d+)?\s*[\])]|\bx\s?\d+|\b\d+\s?x|#\s?\d+|[\[(]\s*\d{1,2}\s*[:h]\s*\d{2}(?::\d{2})?\s*[\])]"
    r"|[←-⯿\U0001f000-\U0001faff]+|\s[-–]+)$"
)
_WORD = re.compile(r"[^\W_]+(?:[.,:/-]\d+)*")
_REPEAT = re.compile(r"(.)\1+", re.DOTALL)
_FIRST_CODE, _LAST_CODE = 0xE000, 0x10FFFF  # above the surrogates


def fold(text: str) -> str:
    """Lower case without accents and invisible signs."""
    plain = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


def canonical(text: str | None) -> tuple[str, ...] | None:
    """The words of an entry without the trifles of its repetition; None for null or blank text."""
    if text is None or not (s := " ".join(fold(text).split())):
        return None
    whole = s
    while m := _LEAD.match(s):
        s = s[m.end() :]
    while m := _TAIL.search(s, max(0, len(s) - 200)):  # a bounded look back keeps long texts linear
        s = s[: m.start()]  # longer trifles go in several steps
    return tuple(_WORD.findall(s)) or (whole,)


def one_slip(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by one inserted, lost, changed or one swapped pair of letters."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


# Calendar words, which name another day or month however close their spelling is.
_CALENDAR = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday lundi mardi mercredi jeudi vendredi samedi dimanche montag dienstag mittwoch "
    "donnerstag freitag samstag sonntag lunes martes miercoles jueves viernes sabado domingo lunedi martedi mercoledi giovedi venerdi sabato "
    "domenica maandag dinsdag woensdag donderdag vrijdag zaterdag zondag segunda terca quarta quinta sexta january february march april may june "
    "july august september october november december janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split()
)


def _two_slips(a: str, b: str) -> bool:
    """Edit distance of at most two (neighbouring letters may be swapped)."""
    if abs(len(a) - len(b)) > 2:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1] <= 2


def _near_word(u: str, v: str) -> bool:
    if u == v:
        return True
    if any(c.isdigit() for c in u) or any(c.isdigit() for c in v) or (u in _CALENDAR and v in _CALENDAR):
        return False
    longest = max(len(u), len(v))
    return (longest >= 2 and one_slip(u, v)) or (longest >= 6 and _two_slips(u, v))


def same_event(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Same words in the same order, up to a few slips of the keyboard in words without digits.

    Numbers, hours, dates and reference numbers must be equal. One word in ten, and at least three
    (one in entries of one or two words), may differ, each by one slip or, as both may be
    mistyped, a longer one by two. A lost or added space between two words counts as well.
    """
    if a == b:
        return True
    if len(a) == len(b):
        differing = [(u, v) for u, v in zip(a, b) if u != v]
        most = 1 if len(a) <= 2 else max(3, len(a) // 10)
        return len(differing) <= most and all(_near_word(u, v) for u, v in differing) and (len(a) > 1 or len(a[0]) >= 5)
    if abs(len(a) - len(b)) == 1:
        x, y = "".join(a), "".join(b)
        return x == y and len(x) >= 8
    return False


class _Run:
    __slots__ = ("author", "first", "last", "n", "start", "end", "form0", "form1")

    def row(self, pid: int, order: int, head: bool, tail: bool) -> tuple:
        forms = ("\x1f".join(self.form0), "\x1f".join(self.form1)) if (head or tail) and self.form0 else (None, None)
        return (pid, order, head, tail, self.author, self.first, self.last, self.n, self.start, self.end, *forms)


_SCHEMA = "pid int, ord bigint, head boolean, tail boolean, author string, first_id string, last_id string, n_events bigint, start_us bigint, end_us bigint, form0 string, form1 string"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _symbols(forms: list, carried: tuple | None) -> str:
    """One code point per entry, by a dictionary of canonical events: an event has the same one wherever it recurs.

    A form nearly the same as that of the entry before, or of the first entry of its run, stands for
    that event. Blank entries have a code point of their own each, so nothing repeats them. ``carried``:
    first and last form and code of the open run. When the code points are used up the dictionary
    starts anew; only neighbours are ever compared through it.
    """
    first, last, code = carried or (None, None, _FIRST_CODE)
    known = {} if last is None else {first: code, last: code}
    free, out = _FIRST_CODE + 1, []
    for f in forms:
        if f is None or last is None or not (same_event(f, last) or same_event(f, first)):
            own = known.get(f) if f is not None else None
            if own is None or own == code:
                if free > _LAST_CODE:
                    known, free = {}, _FIRST_CODE + 1
                own, free = (free, free + 1) if free != code else (free + 1, free + 2)
            code, first = own, f
        if f is not None:
            known.setdefault(f, code)
        last = f
        out.append(chr(code))
    return "".join(out)


def _runs_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one ordered piece of the sequence; only the open run is held between batches."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    open_run: _Run | None = None
    order = 0
    for pdf in batches:
        if pdf.empty:
            continue
        rows: list[tuple] = []
        authors = pdf["author"].to_numpy()
        ids, times = pdf["artifact_id"].to_numpy(), pdf["us"].to_numpy()
        forms = [canonical(x) for x in pdf["content"]]
        cuts = [0, *[i for i in range(1, len(pdf)) if authors[i] != authors[i - 1]], len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):  # one author
            carried = None
            if open_run is not None and open_run.author == authors[lo] and open_run.form1 is not None:
                carried = (open_run.form0, open_run.form1, _FIRST_CODE)
            text = _symbols(forms[lo:hi], carried)
            spans = [(m.start(), m.end()) for m in _REPEAT.finditer(text)]
            pieces, at = [], 0
            for s, e in [*spans, (len(text), len(text))]:
                pieces += [(i, i + 1) for i in range(at, s)]
                if e > s:
                    pieces.append((s, e))
                at = e
            for k, (s, e) in enumerate(pieces):
                joins = k == 0 and carried is not None and text[0] == chr(_FIRST_CODE)
                if joins:
                    open_run.last, open_run.end, open_run.form1 = ids[lo + e - 1], int(times[lo + e - 1]), forms[lo + e - 1]
                    open_run.n += e - s
                    continue
                if open_run is not None:
                    if order == 0 or open_run.n > 1:
                        rows.append(open_run.row(pid, order, order == 0, False))
                    order += 1
                open_run = _Run()
                open_run.author, open_run.first, open_run.last, open_run.n = authors[lo], ids[lo + s], ids[lo + e - 1], e - s
                open_run.start, open_run.end = int(times[lo + s]), int(times[lo + e - 1])
                open_run.form0, open_run.form1 = forms[lo + s], forms[lo + e - 1]
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)
    if open_run is not None:
        yield pd.DataFrame([open_run.row(pid, order, order == 0, True)], columns=_COLUMNS)


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Join runs that a partition boundary cuts. The input is at most two rows per partition."""
    out: list[dict] = []
    forms = lambda x: tuple(x.split("\x1f")) if isinstance(x, str) else None
    for row in pdf.sort_values(["pid", "ord"]).to_dict("records"):
        last = out[-1] if out else None
        if (
            last is not None and row["head"] and last["tail"] and last["author"] == row["author"] and forms(row["form0"]) and forms(last["form1"])
            and (same_event(forms(row["form0"]), forms(last["form1"])) or same_event(forms(row["form0"]), forms(last["form0"])))
        ):
            last |= {k: row[k] for k in ("last_id", "end_us", "form1", "tail")}
            last["n_events"] += row["n_events"]
        else:
            out.append(row)
    return pd.DataFrame(out, columns=_COLUMNS)


def collapse_runs(artifacts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Runs of at least two neighbouring entries: ``author, first_id, last_id, n_events, start_us, end_us, duration_us``.

    Entries with author, time and id, each id once, are ordered by author, time and id. They are
    range-partitioned on that whole order, so the entries of one author may span any number of
    tasks; runs cut by a task boundary are joined afterwards from two rows per task. In each piece
    entries are mapped to the code points of their canonical events, and runs are the backreference
    matches of the resulting string. Null and blank contents belong to no
    run and end one; entries without author, time or id take no part; equal times are ordered by
    id; an empty table gives no runs.
    """
    spark = artifacts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        artifacts.select("artifact_id", "author", micros("recorded_at").alias("us"), "content")
        .where("artifact_id is not null and author is not null and us is not null")
        .groupBy("artifact_id").agg(F.min(F.struct("author", "us", "content")).alias("r"))
        .select("artifact_id", "r.*")
    )
    ordered = rows.repartitionByRange(n, "author", "us", "artifact_id").sortWithinPartitions("author", "us", "artifact_id")
    pieces = ordered.mapInPandas(_runs_of_partition, _SCHEMA)
    pieces = materialise(pieces, "runs")
    edges = pieces.where("head or tail").groupBy(F.lit("edges")).applyInPandas(_stitch, _SCHEMA)
    runs = pieces.where("not head and not tail").unionByName(edges).where("n_events > 1")
    return runs.select("author", "first_id", "last_id", "n_events", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"))
