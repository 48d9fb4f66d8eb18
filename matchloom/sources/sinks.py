"""Sinks (SURVEY K): fixed-column CSV, JSON documents, Markdown and pages with embedded data."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str], order: list[str] | None = None, single_file: bool = False) -> None:
    """K1: fixed columns in a fixed order, null as the empty cell, extra columns left out.

    Large tables are written by range (files sort after one another); `single_file` is for small exports only.
    """
    out = df.select(*fields)
    if order:
        out = df.orderBy(*order).select(*fields)
    if single_file:
        out = df.repartition(1).sortWithinPartitions(*(order or [])).select(*fields) if order else out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", quoteAll=False, escape='"', lineSep="\n")


def json_documents(df: DataFrame, key: str, parts: dict[str, list[str]], order: list[str]) -> DataFrame:
    """K3: one JSON document per key: each part is the ordered list of its columns."""
    cols = [
        F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name) for name, fields in parts.items()
    ]
    return df.groupBy(key).agg(*cols).select(key, F.to_json(F.struct(*parts)).alias("doc"))


def markdown_tables(df: DataFrame, by: list[str], headers: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """K4: a Markdown table per group; a pipe in a value becomes its full-width form."""
    cell = [F.replace(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("|"), F.lit("／")) for f in fields]
    line = F.concat(F.lit("|"), F.concat_ws("|", *cell), F.lit("|"))
    head = "|" + "|".join(headers) + "|\n|" + "|".join("---" for _ in headers) + "|\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return df.groupBy(*by).agg(F.concat(F.lit(head), body).alias("md"))


def page(shell: str, data: dict, placeholder: str = "__DATA__") -> str:
    """K9: a page's shell with its data in the place of a placeholder; a closing tag in the data cannot end the script."""
    if placeholder not in shell:
        raise ValueError(f"the shell lacks {placeholder}")
    return shell.replace(placeholder, json.dumps(data, ensure_ascii=False).replace("</", "<\\/"))


def page_problems(html: str, pages: set[str]) -> list[str]:
    """Q9: embedded data that does not parse, null or NaN in it, and links to pages that are not there."""
    out = []
    for m in re.finditer(r'<script type="application/json"[^>]*>(.*?)</script>', html, re.S):
        try:
            data = json.loads(m.group(1).replace("<\\/", "</"), parse_constant=lambda c: out.append(f"constant {c}"))
        except ValueError as e:
            out.append(f"data: {e}")
            continue
        stack = [("$", data)]
        while stack:
            at, v = stack.pop()
            if v is None:
                out.append(f"null at {at}")
            elif isinstance(v, dict):
                stack += [(f"{at}.{k}", x) for k, x in v.items()]
            elif isinstance(v, list):
                stack += [(f"{at}[{i}]", x) for i, x in enumerate(v)]
    bare = re.sub(r"<script.*?</script>", "", html, flags=re.S)
    out += [f"broken link {h}" for h in re.findall(r'href="([^"#:]+)"', bare) if h not in pages]
    out += [f"token {t}" for t in re.findall(r"\b(?:undefined|NaN|\{\{[^}]*\}\})", bare)]
    return out
