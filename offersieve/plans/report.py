"""Reports: composed analyses, sections, and their files (Markdown, XLSX, HTML). Reports are driver-sized."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.functions.numbers import rate_cell
from offersieve.operators import benchmarks, compensation, grouping, metrics, quality, rejection
from offersieve.operators.filters import Filters, apply_filters, filter_counters, retained
from offersieve.plans.privacy import STANDARD, Rules, dimension_table, scan
from offersieve.schema import DIMENSIONS


@dataclass(frozen=True)
class Analysis:
    """Lazy tables over the filtered records; benchmarks over the reference, by default all retained records."""

    records: DataFrame
    reference: DataFrame
    counters: DataFrame
    summary: DataFrame
    composition: DataFrame
    cycles: DataFrame
    benchmarks: DataFrame


def analyze(records: DataFrame, filters: Filters | None = None, reference: DataFrame | None = None) -> Analysis:
    filters = filters or Filters()
    kept, base = apply_filters(records, filters), retained(records) if reference is None else reference
    return Analysis(kept, base, filter_counters(records, filters), metrics.summarize(kept), metrics.status_composition(kept), metrics.cycles(kept), benchmarks.build(base))


@dataclass(frozen=True)
class Insight:
    overall: DataFrame
    groups: DataFrame
    reasons: DataFrame
    dimensions: dict[str, DataFrame]
    rules: DataFrame
    advice: list[tuple[str, str]]


def rejection_insight(a: Analysis, as_of: str, waiting_days: int = rejection.WAITING_DAYS, comparable: bool = True, edges: Sequence[float] = ()) -> Insight:
    flagged = rejection.with_conditions(benchmarks.decorate(a.records, a.reference, comparable=comparable), as_of, waiting_days, comparable)
    rules = rejection.evaluate_rules(flagged)
    compared = rejection.comparison(a.records)
    tables = {d: grouping.aggregate_by(compared, d, edges) for d in DIMENSIONS if d != "salary_band" or edges}
    advice = rejection.advice(rules, rejection.reason_summary(a.records), a.summary, rejection.long_waits(a.records, as_of, waiting_days))
    return Insight(a.summary, rejection.feature_rates(flagged), rejection.reason_distribution(a.records), tables, rejection.conclusions(rules), advice)


@dataclass(frozen=True)
class Section:
    title: str
    header: tuple[str, ...]
    rows: tuple[tuple[object, ...], ...]
    notes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Report:
    title: str
    as_of: str
    sections: tuple[Section, ...]
    rules: Rules = field(default=STANDARD, repr=False)

    def texts(self) -> list[str]:
        return [str(c) for s in self.sections for r in s.rows for c in r if isinstance(c, str)] + [s.title for s in self.sections] + [n for s in self.sections for n in s.notes]

    def row_counts(self) -> dict[str, int]:
        return {s.title: len(s.rows) for s in self.sections}

    def preview(self, lines: int = 200) -> list[str]:
        out = [self.title]
        for s in self.sections:
            out += [s.title, *["｜".join(map(str, r)) for r in s.rows]]
        return out[:lines]


def _section(title: str, table: DataFrame, notes: Sequence[str] = ()) -> Section:
    """A report table; groups are few after suppression."""
    cell = lambda v: "—" if v is None or v != v else v
    return Section(title, tuple(table.columns), tuple(tuple(cell(v) for v in r) for r in table.collect()), tuple(notes))


def reason_table(records: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """(position, category, n, share, suppressed): with fewer rejections than suppress_below no count and no share is shown."""
    total = records.agg(metrics.count_where(metrics.is_rejected()).alias("_rejected"))  # one row
    hidden = F.col("_rejected").between(1, rules.suppress_below - 1)
    shown = rejection.reason_distribution(records).crossJoin(total)
    return shown.select("position", "category", F.when(hidden, 0).otherwise(F.col("n")).alias("n"), F.when(~hidden, F.col("share")).alias("share"), hidden.alias("suppressed"))


def build(records: DataFrame, as_of: str, rules: Rules = STANDARD, filters: Filters | None = None, issues: DataFrame | None = None, edges: Sequence[float] = ()) -> Report:
    """KPIs, suppressed dimension tables, reasons, conclusions, quality; no record and no free text."""
    a = analyze(records, filters)
    total = F.col("n_core") < rules.suppress_below
    kpi = a.summary.select(
        "n_total", "n_core", rate_cell(F.col("acceptance_rate"), F.col("n_accepted"), F.col("n_core"), total).alias("acceptance"),
        rate_cell(F.col("joined_rate"), F.col("n_joined"), F.col("n_core"), total).alias("joined"),
        rate_cell(F.col("rejection_rate"), F.col("n_rejected"), F.col("n_core"), total).alias("rejection"),
    )
    sections = [_section("关键指标", kpi)]
    for name, label in DIMENSIONS.items():
        if (name == "salary_band" and not edges) or (name == "city" and rules.hide_city):
            continue
        sections.append(_section(label, dimension_table(a.records, name, rules, edges).orderBy("position").drop("code" if name != "recruiter" else "_")))
    flagged = rejection.with_conditions(benchmarks.decorate(a.records, a.reference), as_of)
    sections.append(_section("拒绝原因", reason_table(a.records, rules).orderBy("position").select("category", "n", "share", "suppressed")))
    sections.append(_section("规则结论", rejection.conclusions(rejection.evaluate_rules(flagged)).orderBy("rule_id").select("rule_id", "level", "conclusion")))
    if rules.level != "strict":
        sections.append(_section("薪资分布", compensation.salary_by_unit(a.records).orderBy(F.desc("n")).select("unit", "n", "sufficient")))
    if issues is not None:
        sections.append(_section("数据质量", quality.by_code(issues).orderBy(F.desc("n"), "code")))
    return Report(rules.title, as_of, tuple(sections), rules)


def gate(report: Report, sentinels: Sequence[str]) -> list[str]:
    """Paths at which the report holds a sentinel; it may only be written if there is none."""
    body = {s.title: [list(r) for r in s.rows] + list(s.notes) for s in report.sections}
    return scan(body, sentinels)[1]


# ---------------------------------------------------------------- sinks
def markdown(report: Report) -> str:
    cell = lambda v: re.sub(r"\r\n|\r|\n", " ", str(v).replace("|", "\\|"))
    lines = [f"# {report.title}", "", f"数据截至：{report.as_of}", ""]
    for s in report.sections:
        lines += [f"## {s.title}", "", "| " + " | ".join(s.header) + " |", "|" + " --- |" * len(s.header)]
        lines += ["| " + " | ".join(map(cell, r)) + " |" for r in s.rows] + [""] + [f"> {n}" for n in s.notes]
    return "\n".join(lines) + "\n"


def print_html(report: Report) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    body = "".join(f"<h2>{html.escape(s.title)}</h2><table>{row(s.header, 'th')}{''.join(row(r, 'td') for r in s.rows)}</table>" for s in report.sections)
    return f"<!doctype html><html lang='zh-CN'><meta charset='utf-8'><title>{html.escape(report.title)}</title><body><h1>{html.escape(report.title)}</h1><p>数据截至：{html.escape(report.as_of)}</p>{body}</body></html>"


def safe_value(v: object) -> object:
    """Numbers stay; text that a spreadsheet would compute gets an apostrophe."""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        text = str(v)
        return "'" + text if text[:1] in ("=", "+", "-", "@", "\t", "\r") else text
    return v if v == v and abs(v) != float("inf") else "—"


def sheet_name(title: str, index: int) -> str:
    return (re.sub(r"[\[\]:*?/\\]", " ", title).strip() or f"Sheet{index + 1}")[:31]


def xlsx(report: Report) -> bytes:
    """One sheet for each section, strings inline."""

    def letters(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(v: object, r: int, c: int) -> str:
        v, ref = safe_value(v), f"{letters(c)}{r}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    n = len(report.sections)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(n))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(sheet_name(s.title, i))}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(report.sections))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, s in enumerate(report.sections):
            rows = "".join(f'<row r="{r}">{"".join(cell(v, r, c) for c, v in enumerate(values))}</row>' for r, values in enumerate([s.header, *s.rows], 1))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def file_name(report: Report, extension: str) -> str:
    safe = re.sub(r'[\x00-\x1f\x7f<>:"/\\|?*]+', "_", report.title).strip(" ._") or "report"
    return f"{safe}-{report.as_of.replace('-', '')}.{extension}"


def name_is_safe(name: str, tokens: Sequence[str] = ()) -> bool:
    return not any(t.strip() and t.strip().lower() in name.lower() for t in tokens)


def chart_series(table: DataFrame, title: str) -> DataFrame:
    """(chart, category, series, value): N and D of each visible group, then both totals."""
    shown = table.where("not suppressed")
    pair = lambda n, d: F.inline(F.array(*[F.struct(F.lit(k).alias("series"), F.col(c).alias("value")) for k, c in (("N", n), ("D", d))]))
    bars = shown.select(F.lit(title).alias("chart"), F.col("label").alias("category"), pair("n_total", "n_core"))
    total = shown.agg(F.sum("n_total").alias("n"), F.sum("n_core").alias("d"))
    return bars.unionByName(total.select(F.lit(title).alias("chart"), F.lit("合计").alias("category"), pair("n", "d")))
