"""Citations that texts print: found grammar by grammar, each place claimed once, with pinpoints and back references.

A document's citations depend on one another (a later "cited above" on an earlier name), so a document is read whole, where
it lies; documents are independent and nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions import scalars as S
from docketlake.operators.blocks import _text_rows

FOUND = "ordinal int, block_idx long, para_id string, method string, block_start int, block_end int, document_start int, raw_text string, cited_name string, appnos array<string>, identifier string, pinpoints array<string>, antecedent int"
_KINDS = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.int32()]

_CAP = r"(?:[A-ZÀ-ÖØ-Þ][\w’'\-]*)"
_WORD = rf"(?:(?:[A-Z]\.\s?)+|{_CAP})"
_PARTY = rf"{_WORD}(?:\s+(?:(?:and|et|of|de|du|des|la|le|the|and\s+others|et\s+autres|others|autres)\s+)?(?:{_WORD}|others|autres)){{0,6}}"
_NAME = rf"(?P<name>{_PARTY}\s+(?:v\.|c\.)\s+(?:the\s+|la\s+|le\s+|l['’])?{_CAP}(?:\s+{_CAP}){{0,2}})"
_GC = r"(?:\s*\[GC\])?(?:\s*\((?:dec|déc)\.\))?(?:\s*\[GC\])?"
_NO = r"(?:(?:applications?\s+|requ[êe]tes?\s+)?(?:nos?\.?|n[°ºo]s?\.?))\s*"
_APPS = r"(?P<apps>\d{1,6}/\d{2,4}(?:\s*(?:,|and|et|,\s*and)\s*\d{1,6}/\d{2,4})*)"
_DAY = rf"\d{{1,2}}(?:er)?\s+(?i:{'|'.join(S.MONTHS)})\s+(?:19|20)\d{{2}}"
_REPORTER = r"(?:(?:ECHR|CEDH)\s+(?:19|20)\d{2}(?:[-‑–][IVX]+)?|(?:Reports|Recueil)(?:\s+of\s+Judgments\s+and\s+Decisions|\s+des\s+arr[êe]ts\s+et\s+d[ée]cisions)?\s+19\d{2}-[IVX]+|[Ss][ée]ries?\s+A\s+n[o°º]s?\.?\s*\d+(?:-[A-Z])?)"

#: In order of strength: a place that an earlier grammar has claimed is no other's.
GRAMMARS = [
    ("commission_report", rf"(?:{_NAME}\s*,\s*)?(?:Commission(?:['’]s)?\s+report|report\s+of\s+the\s+Commission|rapport\s+de\s+la\s+Commission)\s+(?:of|du)\s+{_DAY}"),
    ("commission_decision", rf"(?:{_NAME}\s*,\s*)?(?:{_NO}{_APPS}\s*,\s*)?(?:Commission\s+decision|decision\s+of\s+the\s+Commission|d[ée]cision\s+de\s+la\s+Commission)\s+(?:of|du)\s+{_DAY}"),
    ("named_application", rf"{_NAME}{_GC}\s*,?\s*\(?{_NO}{_APPS}\)?"),
    ("named_judgment", rf"{_NAME}{_GC}\s*,?\s*(?:judgment\s+of|(?:the\s+)?decision\s+of|arr[êe]t\s+du|d[ée]cision\s+du)?\s*(?:the\s+)?{_DAY}"),
    ("named_reporter", rf"{_NAME}{_GC}\s*,?\s*{_REPORTER}"),
    ("advisory_opinion", r"(?:[Rr]equest|[Dd]emande)\s+n[o°º]\.?\s*(?P<id>P16-\d{4}-\d{3})"),
    ("decisions_and_reports", r"(?:Decisions\s+and\s+Reports|D[ée]cisions\s+et\s+rapports|\bDR)\s*(?:\(DR\)\s*)?\d+(?:-?[AB])?,?\s*p\.\s*\d+"),
    ("ecli", r"\b(?P<id>ECLI:[A-Z]{2}:[A-Z]+:\d{4}:[0-9A-Z]+)"),
    ("itemid", r"\b(?P<id>001-\d+)\b"),
    ("back_reference", rf"(?:{_NAME}|(?P<short>{_CAP}(?:\s+{_CAP}){{0,4}}(?:\s+(?:and\s+Others|et\s+autres))?))(?:\s*\[GC\])?\s*,?\s*\(?(?:cited\s+above|pr[ée]cit[ée]e?s?)\)?"),
    ("named_case", rf"\b(?:[Cc]ase\s+of|[Aa]ffaire)\s+{_NAME}"),
    ("application", rf"\b{_NO}{_APPS}"),
    ("carried", r"\b(?:[Ii]bid(?:em)?\.?|[Ll]oc\.\s*cit\.?|[Ii]dem)(?=[\s,;.)]|$)"),
]
_COMPILED = [(name, re.compile(pattern)) for name, pattern in GRAMMARS]
_PIN = re.compile(r"^\s*[\])]*\s*,?\s*(?:[^;.\n§]{0,80}?[,\s])?(?:at\s+)?(?:§§?|paras?\.?|paragraphs?|paragraphes?)\s*(\d+(?:\s*[-–]\s*\d+)?(?:\s*(?:,|and|et)\s*\d+(?:\s*[-–]\s*\d+)?)*)")
_LEAD = re.compile(r"^(?:See|also|In|Voir|aussi|Dans|Case\s+of|Affaire|Compare|Contrast|And|Cf\.?)\s+", re.I)


def _spread(apps: str | None) -> list[str]:
    return re.findall(r"\d{1,6}/\d{2,4}", apps or "")


def _bare(name: str | None) -> str | None:
    """A name without the words that lead to it."""
    while name and (lead := _LEAD.match(name)):
        name = name[lead.end() :]
    return name


def find_in_block(text: str) -> list[tuple[int, int, str, re.Match]]:
    """Places of a block's citations, none of which overlap, in order."""
    claimed: list[tuple[int, int, str, re.Match]] = []
    for method, pattern in _COMPILED:
        for m in pattern.finditer(text):
            start, end = m.span()
            while any(m.start(g) >= 0 and m.start(g) <= start for g in ("name", "short") if g in m.re.groupindex) and (lead := _LEAD.match(text[start:end])):
                start += lead.end()
            if all(end <= a or b <= start for a, b, *_ in claimed):
                claimed.append((start, end, method, m))
    return sorted(claimed, key=lambda c: c[:2])


def find_in_text(text: str, sep: str = "\n") -> list[tuple]:
    """Rows of FOUND for one document."""
    rows: list[tuple] = []
    names: list[tuple[str, int]] = []  # folded name, ordinal
    for _, idx, block, at, _, _, kind, para in _text_rows(0, text, sep):
        places = find_in_block(block)
        if kind == "heading" and not any(m in ("ecli", "application", "named_application") for _, _, m, _ in places):
            continue
        strong = None  # the last citation of this block that names a target
        for i, (start, end, method, m) in enumerate(places):
            limit = places[i + 1][0] if i + 1 < len(places) else len(block)
            groups = m.groupdict()
            pin = _PIN.match(block[end : min(limit, end + 240)])
            pins = [re.sub(r"\s*[-–]\s*", "-", p) for p in re.split(r"\s*(?:,|and|et)\s*", pin[1])] if pin else []
            name, short = (_bare(groups.get(g)) for g in ("name", "short"))
            apps, antecedent = _spread(groups.get("apps")), None
            if method == "back_reference":
                wanted = S.fold_text(name or short) or ""
                hits = [o for n, o in names if n == wanted or not name and n.split(" v. ")[0].split(" c. ")[0].startswith(wanted.replace(" and others", "").replace(" et autres", ""))]
                antecedent = hits[-1] if hits and len({rows[h][8] for h in hits}) == 1 else None
                if not name and antecedent is None:
                    continue  # a word before "cited above" that names nothing found before
            elif method == "carried":
                antecedent = strong
            if antecedent is not None and name is None:
                name, apps = rows[antecedent][8], apps or rows[antecedent][9]
            ordinal = len(rows)
            rows.append((ordinal, idx, para, method, start, end, at + start, block[start:end], name, apps, groups.get("id"), pins, antecedent))
            if method not in ("back_reference", "carried"):
                strong = ordinal
                if name:
                    names.append((S.fold_text(name) or "", ordinal))
            elif antecedent is not None:
                strong = antecedent
    return rows


def discover(docs: DataFrame, key: str = "doc_id", sep: str = "\n") -> DataFrame:
    """One row for each citation that a text prints: where, by which grammar, whom it names, its numbers and pinpoints.

    A place belongs to one grammar, the strongest that matches there. Paragraph numbers after a citation are its pinpoints up to
    the next citation or the end of the clause. ``antecedent`` is the ordinal of the citation that "cited above" or "ibid."
    goes back to: the one earlier name that begins so, the last citation of the block. Null or empty texts have no rows.
    """
    kind = dict(docs.dtypes)[key]
    names = [c.split()[0] for c in FOUND.split(", ")]

    def read(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = [(k, *r) for k, text in enumerate(part.column("text").to_pylist()) if text for r in find_in_text(text, sep)]
                columns = list(zip(*rows)) or [()] * (len(names) + 1)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], _KINDS))], [key, *names])

    found = docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(read, f"{key} {kind}, {FOUND}")
    return found.withColumn("locus_id", S.locus_id(F.col(key), F.col("block_idx"), F.col("block_start"), F.col("block_end"), F.col("raw_text"))).withColumn("phase", S.phase(F.col("raw_text"))).withColumn("kind", S.document_kind(F.col("raw_text")))


def coverage(found: DataFrame, listed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Citations found in texts with the listed references (key, mention_id, appnos, title) that they may be: those of the same document
    that share a number, or whose title is contained in one another's."""
    mine = found.select(key, "locus_id", "appnos", S.normalise_title(F.col("cited_name")).alias("title"))
    theirs = listed.select(key, "mention_id", F.col("appnos").alias("l_appnos"), S.normalise_title(F.col("title")).alias("l_title"))
    same = F.arrays_overlap("appnos", "l_appnos") | ((F.col("title") != "") & (F.col("l_title") != "") & (F.contains("title", "l_title") | F.contains("l_title", "title")))
    pairs = mine.join(theirs, key).where(same)
    hits = pairs.groupBy("locus_id").agg(F.array_sort(F.collect_set("mention_id")).alias("mention_ids"))
    state = F.when(F.col("mention_ids").isNull(), "not_covered").when(F.size("mention_ids") == 1, "covered").otherwise("indeterminate")
    return found.select(key, "locus_id").join(hits, "locus_id", "left").withColumn("coverage", state)
