"""Skills, commands and agents as Markdown files with front matter, by a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def head_fields(lines: list[str]) -> tuple[dict[str, str], list[str]]:
    """The fields of a head by dotted name, and what couldn't be read.

    A field is ``name: value``; deeper ones are named after those they stand under. ``|`` keeps the lines that follow, ``>`` joins
    them, and so does a value that goes on in deeper lines. A list's items are joined by commas. Quotes around a value go.
    """
    fields: dict[str, str] = {}
    problems: list[str] = []
    above: list[tuple[int, str]] = []  # (indent, dotted name)
    at = 0

    def indent(line: str) -> int:
        return len(line) - len(line.lstrip(" "))

    def block(start: int, least: int) -> tuple[list[str], int]:
        end = start
        while end < len(lines) and (not lines[end].strip() or indent(lines[end]) >= least):
            end += 1
        own = lines[start:end]
        cut = min((indent(x) for x in own if x.strip()), default=0)
        return [x[cut:] for x in own], end

    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        deep, text = indent(line), line.strip()
        while above and above[-1][0] >= deep and not (text.startswith("- ") and above[-1][0] == deep):
            above.pop()
        if "\t" in line[: len(line) - len(line.lstrip())]:
            problems.append(f"line {at}: tab")
        elif text.startswith("- ") and above:
            name = above[-1][1]
            fields[name] = ", ".join(x for x in (fields.get(name), text[2:].strip().strip("\"'")) if x)
        elif ":" not in text:
            problems.append(f"line {at}: no field")
        else:
            name, value = (x.strip() for x in text.split(":", 1))
            dotted = ".".join([*(above[-1:] and [above[-1][1]]), name])
            if value[:1] in ("|", ">"):
                own, at = block(at, deep + 1)
                fields[dotted] = ("\n" if value[0] == "|" else " ").join(own if value[0] == "|" else [x.strip() for x in own if x.strip()]).strip()
            elif value:
                own, end = block(at, deep + 1)
                fields[dotted] = " ".join([value.strip("\"'"), *(x.strip() for x in own if x.strip())])
                at = end
            else:
                fields.setdefault(dotted, "")
                above.append((deep, dotted))
    return {k: v for k, v in fields.items() if v}, problems


@udtf(returnType="fields map<string,string>, body string, warning string", useArrow=True)
class FrontMatter:
    """A row for a file: the fields of its head, what follows it, and what is wrong with the head."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = (text or "").replace("\r\n", "\n").split("\n")
        if lines[0].strip() != "---":
            yield {}, text or "", "no front matter"
            return
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        if end is None:
            yield {}, text, "front matter isn't closed"
            return
        fields, problems = head_fields(lines[1:end])
        yield fields, "\n".join(lines[end + 1 :]), "; ".join(problems) or None


def markdown_catalog(spark: SparkSession, *globs: str) -> DataFrame:
    """(path, name, description, fields, body, warning) of Markdown files; a file without a name in its head is named after its folder, or itself.

    A path that isn't there gives no rows. Of files with one name the first by path counts.
    """
    spark.udtf.register("front_matter", FrontMatter)
    files = spark.read.format("binaryFile").load(list(globs)).select("path", F.col("content").cast("string").alias("value"))
    rows = files.lateralJoin(FrontMatter(F.col("value").outer()))
    stem, folder = F.regexp_extract("path", r"([^/]+)\.md$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    named = F.coalesce(F.col("fields")["name"], F.when(stem == "SKILL", folder).otherwise(stem))
    rows = rows.select("path", named.alias("name"), F.col("fields")["description"].alias("description"), "fields", "body", "warning")
    return rows.groupBy("name").agg(F.min_by(F.struct("path", "description", "fields", "body", "warning"), "path").alias("f")).select("f.path", "name", "f.description", "f.fields", "f.body", "f.warning")
