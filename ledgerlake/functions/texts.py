"""Texts for people: times of a zone, run summaries, labels of transfers, filled templates. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import human_bytes


def at_zone(utc: Column, zone: str) -> Column:
    """The wall clock of a zone at a UTC time, both without a zone of their own."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def local_time(utc: Column, zone: str) -> Column:
    """A UTC time on the wall clock of a zone: 2024-01-31 08:05:00."""
    return F.date_format(at_zone(utc, zone), "yyyy-MM-dd HH:mm:ss")


def utc_offset(utc: Column, zone: str) -> Column:
    """The offset that a zone has at a UTC time: UTC+08:00."""
    minutes = F.timestamp_diff("MINUTE", utc.cast("timestamp_ntz"), at_zone(utc, zone))
    size = F.abs(minutes)
    return F.format_string("UTC%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60), size % 60)


def version_span(started: Column, completed: Column, zone: str) -> Column:
    """Start and end on the wall clock of a zone; the day stands once if it is the same there. An unknown start is a
    dash."""
    start, end = local_time(started, zone), local_time(completed, zone)
    short = F.when(F.substring(start, 1, 10) == F.substring(end, 1, 10), F.substring(end, 12, 8)).otherwise(end)
    return F.concat(F.coalesce(start, F.lit("—")), F.lit(" → "), F.when(start.isNull(), end).otherwise(short))


def transfer_label(kind: Column, ref: Column, members: Column, first_path: Column) -> Column:
    """A pack with the number of files that are taken from it; else the path of the one file, or the bare reference."""
    count = F.concat(F.lit("pack "), ref, F.lit(" ("), members.cast("string"), F.when(members == 1, " file)").otherwise(" files)"))
    return F.when(kind == "pack", count).when(members > 0, first_path).otherwise(ref)


def url_escaped(text: Column) -> Column:
    """Percent escapes for all but letters, digits and - . _ ~."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def json_escaped(text: Column) -> Column:
    """The inside of a JSON string; characters beyond ASCII stay as they are."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def fill_template(template: Column, title: Column, body: Column, escape: str | None = None) -> Column:
    """template with {TitleRaw}, {BodyRaw}, {Title} and {Body} filled in, in this order and in any case of letters;
    escape ("url", "json" or None) goes for the last two."""
    escaped = {"url": url_escaped, "json": json_escaped, None: lambda c: c}[escape]
    for name, value in (("TitleRaw", title), ("BodyRaw", body), ("Title", escaped(title)), ("Body", escaped(body))):
        literal = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        template = F.regexp_replace(template, F.lit(rf"(?i)\{{{name}\}}"), literal)
    return template


def _some(count: Column, words: Column) -> Column:
    """The words if the count is over zero, else null, which concat_ws leaves out."""
    return F.when(count > 0, words)


def _counted(count: Column, word: str) -> Column:
    return _some(count, F.concat(count.cast("string"), F.lit(f" {word}")))


def retention_line(retired: Column, packs: Column, blobs: Column, freed: Column) -> Column:
    """What a cleanup did; parts that are zero are left out, and the line is null if all are."""
    objects = F.concat_ws(" + ", _counted(packs, "pack(s)"), _counted(blobs, "blob(s)"))
    parts = F.concat_ws(
        ", ",
        _some(retired, F.concat(F.lit("retired "), retired.cast("string"), F.lit(" version(s)"))),
        F.when(objects != "", F.concat(F.lit("deleted "), objects)),
        _some(freed, F.concat(F.lit("freed "), human_bytes(freed))),
    )
    return F.when(parts != "", F.concat(F.lit("Retention: "), parts))


def run_summary(version: Column, new: Column, modified: Column, deleted: Column, deleted_bytes: Column, unreadable: Column, changed_bytes: Column, uploaded_bytes: Column, retention: Column, skipped: Column) -> Column:
    """The lines of a run: version, files, data, cleanup. Counts of zero are left out, and lines without any figure
    too, but for the line of files. Bytes changed and bytes uploaded stand together, as one of them may be zero."""
    weight = F.when(deleted_bytes > 0, F.concat(F.lit(" ("), human_bytes(deleted_bytes), F.lit(")"))).otherwise("")
    files = F.concat_ws(", ", _counted(new, "new"), _counted(modified, "modified"), F.concat(_counted(deleted, "deleted"), weight), _counted(unreadable, "unreadable (skipped)"))
    data = F.concat(F.lit("Data: "), human_bytes(changed_bytes), F.lit(" changed at source → "), human_bytes(uploaded_bytes), F.lit(" uploaded"))
    why = F.when(skipped != "", F.concat(F.lit("Cleanup: skipped, will retry next run ("), skipped, F.lit(")")))
    return F.concat_ws("\n", F.concat(F.lit("Version "), version.cast("string")), F.concat(F.lit("Files: "), F.when(files == "", "no changes").otherwise(files)), F.when((changed_bytes > 0) | (uploaded_bytes > 0), data), retention, why)
