"""Fill-in-the-middle: a text is cut into units at two places and its middle moves to the end, behind sentinels.

One fullmatch of ``(unit)*`` by the regex library keeps every repetition of the group: ``m.ends(1)`` gives the number
of units and, by index, both cut offsets, without a loop over units. The group repeats possessively, so no state for
backtracking is kept; this changes nothing for units that a match never has to give back, as lines. A capture costs
about 220 bytes and the library ends at some four million of them, so one match takes at most ``UNITS``; a text of more
is matched on from where the last match ended.

Places and form follow from the sha256 of ``seed:doc_id`` alone: a rerun on any partitioning gives the same rows, and
rows that share an id are drawn alike. ``restore`` rebuilds the exact text from output and form.

Defined cases: a null text counts as empty and stays plain; a null id is drawn as the string ``seed:`` alone; texts that
hold a sentinel stay plain. Repeated rows are kept, extra columns are left out. A unit pattern that does not cover a text
fails the task.
"""

import hashlib
from array import array

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from dealsift.llm import textkit as T
from dealsift.llm.tables import documents

#: Fixed values of the format: one line with its end, or the last one without; marks of prefix, suffix and middle.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")

#: Units of one match.
UNITS = 200_000


def unit_pattern(unit: str, most: int = UNITS) -> regex.Pattern:
    return regex.compile(rf"(?:({unit})){{0,{most}}}+")


def unit_ends(pattern: regex.Pattern, text: str):
    """End of every unit of a text; units have to cover it."""
    match = pattern.fullmatch(text)
    if match is not None:
        return match.ends(1)
    ends, at = array("q"), 0
    while at < len(text):
        match = pattern.match(text, at)
        if match.end() == at:
            raise ValueError("units do not cover a text")
        ends.extend(match.ends(1))
        at = match.end()
    return ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits for one document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    ``percent`` of the documents are cut, ``spm_percent`` of these with the suffix in front.
    """
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("sentinels must be three different strings")

    def run(batches):
        pattern = unit_pattern(unit)
        p, s, m = sentinels
        for batch in batches:
            for part in T.slices(batch):
                rows = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    text = text.as_py() or ""
                    ends = unit_ends(pattern, text)
                    n = len(ends)
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (ends[k - 1] if k else 0 for k in (first, last))
                    if not text or any(mark in text for mark in sentinels) or h3 % 100 >= percent:
                        form, sizes, output = "plain", (None, None), text
                    elif h4 % 100 < spm_percent:
                        form, sizes, output = "spm", (a, b - a), "".join((s, text[b:], p, text[:a], m, text[a:b]))
                    else:
                        form, sizes, output = "psm", (a, b - a), "".join((p, text[:a], s, text[b:], m, text[a:b]))
                    for name, value in zip(rows, (n, form, *sizes, output)):
                        rows[name].append(value)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **{k: pa.array(v, t) for (k, v), t in zip(rows.items(), types)}})

    return documents(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from output and form alone: no text that was cut holds a sentinel, so the marks part it."""
    marks = "|".join("\\Q" + mark + "\\E" for mark in sentinels)
    parts = F.split(F.col(output), marks, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``transform`` with digests of the output and of the restored text in place of the output."""
    cut = transform(docs, **options).withColumn("restored", restore(sentinels=options.get("sentinels", SENTINELS)))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "utf-8"), 256).alias("output_sha256"), F.sha2(F.encode("restored", "utf-8"), 256).alias("restored_sha256"))


#: DuckDB. Lines by splitting; a text that ends with a line end has no line behind it.
ORACLE = r"""
with base as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
counted as (select *, len(lines) - case when lines[-1] = '' then 1 else 0 end as n from base),
drawn as (
  select *, ('0x' || h[1:8])::bigint % (n + 1) as k1, ('0x' || h[9:16])::bigint % (n + 1) as k2, ('0x' || h[25:32])::bigint % 100 as side from counted),
cut as (
  select *, case when least(k1, k2) = 0 then '' when least(k1, k2) = n then text else array_to_string(lines[1:least(k1, k2)], chr(10)) || chr(10) end as prefix,
    case when greatest(k1, k2) = 0 then '' when greatest(k1, k2) = n then text else array_to_string(lines[1:greatest(k1, k2)], chr(10)) || chr(10) end as front from drawn),
parts as (
  select *, substr(front, length(prefix) + 1) as middle, substr(text, length(front) + 1) as suffix,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when side < 50 then 'spm' else 'psm' end as form from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
