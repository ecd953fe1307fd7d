"""File names as a source of columns: templates such as `(assay)/(channel)_(row)_(col)_(time|%Y%m%d).tif`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = {"assay": "str", "channel": "str", "time": "time", "row": "int", "col": "int"}
DEFAULT_TIME = "%Y%m%d-%H%M%S"
#: Strptime directives and the patterns of Spark's timestamps.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "p": "a", "I": "hh", "%": "%"}
SPECIFIER = re.compile(r"\(([A-Za-z_]+)((?:\|[^()|]*)*)\)")


@dataclass(frozen=True)
class Specifier:
    """A captured column; of: the dimension that an attached value belongs to."""

    name: str
    kind: str
    format: str
    of: str | None = None


def spark_pattern(strptime: str) -> str:
    out, at = "", 0
    for m in re.finditer(r"%(.)", strptime):
        out += re.sub(r"([A-Za-z]+)", r"'\1'", strptime[at : m.start()])
        if m[1] not in DIRECTIVES:
            raise ValueError(f"%{m[1]} in a time format is not known")
        out += DIRECTIVES[m[1]]
        at = m.end()
    return out + re.sub(r"([A-Za-z]+)", r"'\1'", strptime[at:])


def specifiers(template: str) -> list[Specifier]:
    """Of a template, in order. `(NAME_DIM|TYPE|FORMAT)` attaches NAME to a dimension; one or more underscores part the two."""
    out = []
    for m in SPECIFIER.finditer(template):
        options = m[2].split("|")[1:]
        if m[1] in DIMS:
            kind = DIMS[m[1]]
            out.append(Specifier(m[1], kind, options[0] if options else DEFAULT_TIME if kind == "time" else ""))
            continue
        base, _, dim = m[1].rpartition("_")
        if dim not in DIMS or not base.strip("_"):
            raise ValueError(f"unknown specifier {m[0]} in a path")
        kind = options[0] if options and options[0] in ("str", "int", "float", "time") else "str" if not options else "time"
        rest = options[1:] if options and options[0] in ("str", "int", "float", "time") else options
        out.append(Specifier(base.strip("_"), kind, rest[0] if rest else DEFAULT_TIME if kind == "time" else "", dim))
    if len({s.name for s in out}) < len(out):
        raise ValueError("a specifier stands twice in the path")
    return out


def glob_of(template: str) -> str:
    return SPECIFIER.sub("*", template)


def regex_of(template: str) -> str:
    """The expression whose groups are the specifiers; they and wildcards stay within a path segment, letters match in either case."""
    out, at = "(?i)", 0
    plain = lambda s: re.escape(s).replace(r"\*\*", ".*").replace(r"\*", r"[^/\\]*").replace(r"\?", r"[^/\\]")
    for m in SPECIFIER.finditer(template):
        out += plain(template[at : m.start()]) + r"([^/\\]*?)"
        at = m.end()
    return out + plain(template[at:]) + "$"


def typed(value: Column, kind: str, form: str) -> Column:
    """A captured string in its type; null where it doesn't parse. Times are seconds since 1970 in UTC."""
    if kind == "time":
        return F.unix_timestamp(F.try_to_timestamp(value, F.lit(spark_pattern(form))))
    return value.try_cast({"int": "int", "float": "double"}[kind]) if kind in ("int", "float") else value


def extract(df: DataFrame, template: str, path: str = "path") -> DataFrame:
    """df with a column for each specifier, for the rows whose path fits the template."""
    pattern = regex_of(template)
    out = df.filter(F.col(path).rlike(pattern))
    return out.select("*", *[typed(F.regexp_extract(path, pattern, i + 1), s.kind, s.format).alias(s.name) for i, s in enumerate(specifiers(template))])


def duplicates(df: DataFrame, index: list[str]) -> DataFrame:
    """Index tuples that several paths have, with their number."""
    return df.groupBy(*index).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def attached(df: DataFrame, value: str, dim: str, path: str = "path") -> DataFrame:
    """dim, value: the attached value of each value of the dimension; the last path by name wins."""
    return df.groupBy(dim).agg(F.max_by(value, path).alias(value))


def list_files(spark, template: str) -> DataFrame:
    """path and the typed columns of all files that fit. None: FileNotFoundError. Two with the same indices: ValueError."""
    try:
        rows = with_content(spark, template).drop("content")
        if rows.isEmpty():
            raise FileNotFoundError(f"no file fits {template}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no file fits {template}") from None
        raise
    index = [s.name for s in specifiers(template) if s.of is None]
    if index and not (twice := duplicates(rows, index)).isEmpty():
        raise ValueError(f"several files have the same indices: {twice.first().asDict()}")
    return rows


def with_content(spark, template: str) -> DataFrame:
    """path, content and the typed columns of all files that fit; content is read only where it is used."""
    found = spark.read.format("binaryFile").load(glob_of(template)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return extract(found, _anywhere(template))


def _anywhere(template: str) -> str:
    return template if template.startswith(("/", "*")) else f"**{template}"
