"""File names: labels, set names, volume numbers, globs and safe paths. All as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a set's name, by priority, and the first index of each series of numbered extensions.
MARKERS = (".part", ".vol", ".par2", ".rev", ".rar")
SERIES = (("r", 1), ("s", 101))
LAST_SERIES_INDEX = 999


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def set_hint(name: Column) -> Column:
    """What comes before the first of the markers that the name holds; by the markers' order, not by place."""
    low, out = F.lower(name), name
    for m in reversed(MARKERS):
        at = F.instr(low, m)
        out = F.when(at > 1, F.substring(name, F.lit(1), at - 1)).otherwise(out)
    return out


def old_volume_index(name: Column) -> Column:
    """The place of a volume by its extension; null if it has none."""
    ext = extension(name)
    number = F.regexp_extract(ext, r"(\d+)$", 1)
    n = F.expr("null").cast("long")
    n = F.when(ext.rlike(r"^\d+$"), F.greatest(ext.cast("long") - 1, F.lit(0))).otherwise(n)
    for letter, first in SERIES:
        n = F.when(ext.rlike(rf"^{letter}\d\d$"), number.cast("long") + first).otherwise(n)
    n = F.when(ext.rlike(r"^[a-qt-z]\d\d$"), F.lit(LAST_SERIES_INDEX).cast("long")).otherwise(n)
    return F.when(ext == "rar", F.lit(0).cast("long")).otherwise(n)


def part_number(name: Column) -> Column:
    """The number in .partN. names."""
    n = F.regexp_extract(F.lower(name), r"\.part(\d+)\.", 1)
    return F.when(n != "", n.cast("long"))


def safe_label(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def recovery_base(name: Column) -> Column:
    """Without .volN+M and .par2."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.par2$", ""), r"(?i)\.vol\d+\+\d+$", "")


def next_volume(name: Column) -> Column:
    """The next .partNN.rar name, in as many digits."""
    m = r"(?i)^(.*\.part)(\d+)(\.rar)$"
    digits = F.regexp_extract(name, m, 2)
    n = (digits.cast("long") + 1).cast("string")
    return F.when(digits != "", F.concat(F.regexp_extract(name, m, 1), F.lpad(n, F.greatest(F.length(digits), F.length(n)), "0"), F.regexp_extract(name, m, 3)))


def free_name(name: Column, taken: Column, most: int = 1000) -> Column:
    """The first of name, stem(1).ext, stem(2).ext ... that is not in the array `taken`."""
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    tries = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.concat(stem, F.lit("("), i.cast("string"), F.lit(")"), ext))
    return F.element_at(F.array_except(F.concat(F.array(name), tries), taken), 1)


def sanitized(path: Column) -> Column:
    """Up to the first NUL, slashes one way, no drive, root or parent steps."""
    p = F.replace(F.substring_index(path, "\x00", 1), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"^[A-Za-z]:", "")
    steps = F.filter(F.split(p, "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(steps, "/")


def escaped_name(name: Column) -> Column:
    """A stored name as a relative path: control letters, roots and parent steps as percent codes."""

    def step(s: Column) -> Column:
        letters = F.transform(F.split(s, ""), lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f%]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
        return F.when(s.isin(".", ".."), F.replace(s, F.lit("."), F.lit("%2E"))).otherwise(F.array_join(letters, ""))

    steps = F.transform(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), step)
    return F.array_join(F.filter(steps, lambda s: s != ""), "/")


def safe_link(target: Column, depth: Column) -> Column:
    """Whether a relative link from a folder at `depth` never climbs above the root."""
    steps = F.filter(F.split(target, "/"), lambda s: ~s.isin("", "."))
    lowest = F.aggregate(
        steps,
        F.struct(depth.cast("int").alias("at"), depth.cast("int").alias("low")),
        lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")),
        lambda a: a["low"],
    )
    return ~target.startswith("/") & ~target.rlike(r"^[A-Za-z]:") & (lowest >= 0)


def glob_regex(pattern: str, paths: bool = False, ignore_case: bool = False) -> str:
    """A regular expression for * and ?; with paths, ** spans whole components and * and ? stay within one."""
    out, i = "", 0
    while i < len(pattern):
        if paths and pattern.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif paths and pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*" if paths else ".*", "?": "[^/]" if paths else "."}.get(c, re.escape(c))
            i += 1
    return ("(?is)" if ignore_case else "(?s)") + f"^{out}$"


def glob(name: Column, pattern: str, paths: bool = False, ignore_case: bool = False) -> Column:
    return name.rlike(glob_regex(pattern, paths, ignore_case))


def first_fit_regex(pattern: str) -> str:
    """* only, case as it is, each literal at its first place after the one before: the last literal must end the
    name where it is first found, so *.rar does not match a.rar.rar."""
    parts = pattern.split("*")
    if len(parts) == 1:
        return f"(?s)^{re.escape(pattern)}$"
    out = f"(?s)^{re.escape(parts[0])}"
    for p in parts[1:]:
        if p:
            out += f"(?:(?!{re.escape(p)}).)*+{re.escape(p)}"
    return out + ("$" if parts[-1] else ".*$")


def after_traversal(path: Column, drives: bool = True) -> Column:
    """What comes after the last parent step and, of that, after drives, shares, roots and steps that stay in place."""
    p = F.replace(F.substring_index(path, "\x00", 1), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"^(?s:.*)/\.\.(?:/|$)", "")
    start = r"//[^/]*/[^/]*/|[./]*/"
    return F.regexp_replace(p, rf"^(?:(?s:.):|{start})+" if drives else rf"^(?:{start})+", "")


def old_next_volume(name: Column, index: Column) -> Column:
    """The name of a volume after the first in the old numbering: .r00 is index 1."""
    base = F.regexp_replace(name, r"\.(rar|RAR)$", "")
    n = F.greatest(index - 1, F.lit(0)).cast("string")
    return F.concat(base, F.lit(".r"), F.lpad(n, F.greatest(F.length(n), F.lit(2)), "0"))


def group_key(folder: Column, name: Column, first_member: Column) -> Column:
    """Volumes of one archive: folder and set name; where the name says nothing, the first member's name."""
    told = extension(name).rlike(r"^(rar|rev|[rs]\d\d|\d{3})$")
    return F.concat_ws(":", folder, F.when(told, set_hint(name)).otherwise(F.coalesce(F.nullif(first_member, F.lit("")), set_hint(name))))


def related_label(label: Column, name: Column) -> Column:
    """Whether a name is of a set: its set name is the label, or it begins with the label."""
    return (set_hint(name) == label) | F.startswith(name, label)


def made_by_create(name: Column) -> Column:
    """Temporary files of writers: hidden names that end in .tmp."""
    return name.rlike(r"^\..*\.tmp$")
