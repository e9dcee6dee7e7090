"""Text for people and models: the subgraph as context, prompts and the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONTAIN, CONTEXT_CHARS, INVOKE, OVERRIDE, TRUNCATED


def context_lines(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file, line, node_id, text): one block of text a definition, with what calls it, overrides it and is called by it."""
    defs = nodes.filter("type = 'def'")
    marked = defs.join(seeds.select("node_id", F.lit(" [changed]").alias("mark")).distinct(), "node_id", "left")
    at = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("s_name"), F.col("file").alias("s_file"), F.col("line").alias("s_line"))
    held = edges.filter(F.col("edge_type") == CONTAIN)
    boxes = held.join(nodes.select(F.col("node_id").alias("src"), F.col("name").alias("box")), "src").groupBy(F.col("dst").alias("src")).agg(F.min_by("box", "edge_seq").alias("box"))
    into = edges.filter(F.col("edge_type").isin(INVOKE, OVERRIDE)).join(at, "src").join(boxes, "src", "left")
    place = F.concat(F.lit(" ("), "s_file", F.lit(":"), F.col("s_line").cast("string"))
    call = F.concat("s_name", place, F.coalesce(F.concat(F.lit(" in "), "box"), F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(" [conf: "), F.format_number("confidence", 2), F.lit("]")), F.lit("")))
    text = F.when(F.col("edge_type") == OVERRIDE, F.concat(F.lit("[override] "), "s_name", place, F.lit(")"))).otherwise(call)
    callers = into.groupBy(F.col("dst").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", text.alias("t")))), lambda x: F.concat(F.lit("\n      - "), x["t"])), "").alias("callers"))
    target = nodes.select(F.col("node_id").alias("dst"), F.concat("name", F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")")).alias("t"))
    out = held.select(F.col("src").alias("node_id"), F.col("dst").alias("src")).join(edges.filter(F.col("edge_type") == INVOKE).select("src", "dst", "edge_seq"), "src").join(target, "dst")
    calls = out.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", "t"))), lambda x: F.concat(F.lit("\n      - "), x["t"])), "").alias("calls"))
    rows = marked.join(callers, "node_id", "left").join(calls, "node_id", "left")
    sig = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit(" "), "signature")).otherwise("")
    block = F.concat(
        F.lit("  "),
        F.upper("category"),
        F.lit(": "),
        "name",
        sig,
        F.coalesce("mark", F.lit("")),
        F.lit(" (line "),
        F.col("line").cast("string"),
        F.lit(")"),
        F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n    Code: "), "snippet")).otherwise(""),
        F.coalesce(F.concat(F.lit("\n    Called or overridden by:"), "callers"), F.lit("")),
        F.coalesce(F.concat(F.lit("\n    Calls:"), "calls"), F.lit("")),
    )
    return rows.select("file", "line", "node_id", block.alias("text"))


def context_by_file(lines: DataFrame) -> DataFrame:
    """(file, text): the blocks of each file in order of line."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("line", "node_id", "text"))), lambda x: x["text"])
    return lines.groupBy("file").agg(F.concat(F.lit("FILE: "), F.first("file"), F.lit("\n"), F.array_join(blocks, "\n")).alias("text"))


def serialize_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, diff_text: str = "", tests: list[dict] | None = None, most_chars: int = CONTEXT_CHARS) -> str:
    """The subgraph of a change as one text, cut at most_chars."""
    if nodes.isEmpty():
        return "No nodes of the graph are affected."
    out = ["=== CONTEXT OF THE CHANGE ===", "", "--- DIFF ---", diff_text.strip() or "(none)", "", "--- CHANGED SYMBOLS ---"]
    size = sum(map(len, out))
    for s in nodes.join(seeds.select("node_id").distinct(), "node_id", "left_semi").orderBy("node_seq").toLocalIterator():
        if size > most_chars:  # what follows is cut off anyway
            break
        span = f"L{s['line']}-L{s['end_line']}" if s["end_line"] and s["end_line"] != s["line"] else f"line {s['line']}"
        sig = f" `{s['signature']}`" if s["signature"] else ""
        out.append(f"- [{s['category'].upper()}] {s['name']}{sig} ({s['file']}, {span})")
        if s["snippet"]:
            out.append(f"  Code: `{s['snippet']}`")
        size += len(out[-1])
    if tests:
        out += ["", "--- TESTS TO RUN ---"]
        for t in tests:
            out += [f"- [{t['classification'].upper()}] {t['test_name']} ({t['test_file']}) - score {t['impact_score']:.2f}", f"  {t['reason']}"]
    out += ["", "--- DEPENDENCIES ---"]
    size = sum(map(len, out))
    for r in context_by_file(context_lines(nodes, edges, seeds)).orderBy("file").toLocalIterator():
        out += [r["text"], ""]
        size += len(r["text"])
        if size > most_chars:
            break
    text = "\n".join(out)
    return text if len(text) <= most_chars else text[:most_chars] + TRUNCATED


def impact_prompts(context: str, diff_text: str) -> dict[str, str]:
    """System and user prompt for a language model that writes the report."""
    return {
        "system_prompt": "You review code changes. From a diff and the part of the dependency graph around it, name the files, symbols, callers, subclasses and tests that the change affects, with lines, reasons, needed edits and how sure you are.",
        "user_prompt": f"{context}\n\nWrite a Markdown report: what changed; which files and lines are affected; why each is; which edits each needs; which tests to run or add.",
    }


def markdown_report(summary: dict) -> str:
    """A report by rule from the parts of an analysis, each a list of dicts."""
    out = ["# Impact of the change", "", "## Summary", "", f"{len(summary['seeds'])} changed symbols; {len(summary['direct'])} direct and {len(summary['indirect'])} indirect dependants in {len(summary['files'])} files.", "", "## Changed symbols", ""]
    out += [f"- `{s['name']}` ({s['category']}) in `{s['file']}`, line {s['line']}" for s in summary["seeds"]] or ["- none found"]
    out += ["", "## Affected code", "", "> Listed code is worth a review; it need not change.", ""]
    number = 0
    for part, reason in (("direct", "calls, overrides or extends a changed symbol"), ("indirect", "depends on it through others")):
        for r in summary[part]:
            number += 1
            test = part == "indirect" and any(t in r["file"].lower() for t in ("test", "spec", "check"))
            out += [f"### {number}. `{r['file']}`", f"- line {r['line']}: `{r['name']}` ({r['category']})", f"- {'tests the changed path' if test else reason}", ""]
    if not number:
        out += ["Nothing else is affected within the hop limit.", ""]
    if summary.get("candidates"):
        out += ["### Unsure callers", *[f"- `{c['name']}` in `{c['file']}`, line {c['line']}" for c in summary["candidates"]], ""]
    if summary.get("tests"):
        out += ["## Tests", "", *[f"- [{t['classification']}] `{t['test_name']}` (`{t['test_file']}`), score {t['impact_score']:.2f}: {t['reason']}" for t in summary["tests"]], ""]
    if summary.get("errors"):
        out += ["## What may break", "", *[f"- {e['severity']}: {e['error_type']} at {e['file']}:{e['line']}. {e['recommended_fix']}" for e in summary["errors"]], ""]
    out += ["## Checklist", "", "- [ ] Signatures agree at all call sites.", "- [ ] The direct tests pass.", "- [ ] Indirect dependants were reviewed.", "- [ ] Files that usually change together are in the change."]
    return "\n".join(out)


def write_report(summary: dict, model: Callable[[dict[str, str]], str] | None = None, context: str = "", diff_text: str = "") -> str:
    """The model's report, or the one by rule without a model or if it fails."""
    if model is not None:
        try:
            return model(impact_prompts(context, diff_text))
        except Exception:
            pass
    return markdown_report(summary)


def compact_report(rows: list[dict], most_symbols: int = 3, most_lines: int = 6) -> str:
    """A few symbols and lines of each file, files with direct dependants first."""
    files: dict[str, list[dict]] = {}
    for r in rows:
        files.setdefault(r["file"], []).append(r)
    out = []
    for file, own in sorted(files.items(), key=lambda x: (not any(r.get("is_direct") for r in x[1]), x[0])):
        names = ", ".join(dict.fromkeys(r["name"] for r in own[: most_symbols * 4]))
        shown = ", ".join(names.split(", ")[:most_symbols])
        lines = ", ".join(map(str, sorted({r["line"] for r in own})[:most_lines]))
        out.append(f"{file}: {shown} (lines {lines})")
    return "\n".join(out)
