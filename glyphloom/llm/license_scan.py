"""Licence scan by sentence rules.

Sentences are compared by their words in lower case without punctuation. A known sentence
has an identifier; a licence rule is an ordered sequence of identifiers. Within a text
the longest rule that fits at a sentence wins, and its sentences are not used again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# Sentences of public licences and of common licence notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-line-3": "This project is licensed under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "Released under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Licences by the order of their sentences.
RULES = {
    "mit-text": ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    "mit-grant": ("MIT", ("mit-grant",)),
    "mit-line": ("MIT", ("mit-line",)),
    "mit-line-2": ("MIT", ("mit-line-2",)),
    "mit-line-3": ("MIT", ("mit-line-3",)),
    "apache-header": ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-url", "apache-warranty", "apache-limits")),
    "apache-header-short": ("Apache-2.0", ("apache-notice", "apache-comply")),
    "apache-line": ("Apache-2.0", ("apache-line",)),
    "gpl3-header": ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    "gpl3-free": ("GPL-3.0-or-later", ("gpl-free",)),
    "gpl3-line": ("GPL-3.0-only", ("gpl3-line",)),
    "gpl2-header": ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    "gpl2-free": ("GPL-2.0-or-later", ("gpl2-free",)),
    "bsd-3": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    "bsd-2": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "isc": ("ISC", ("isc-grant",)),
    "cc-by-nc-line": ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    "cc-by-line": ("CC-BY-4.0", ("cc-by-line",)),
    "cc-by-sa-line": ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    "cc0-line": ("CC0-1.0", ("cc0-line",)),
    "unlicense": ("Unlicense", ("unlicense",)),
}
#: Words of other text that may stand between two sentences of a rule.
GAP = 12
#: Every known sentence holds one of these, so other texts need no look.
HINT = r"(?i)licen|permission|warrant|redistribut|copyright|free software|liable|unencumbered|CC0|compliance"

_TOKEN = re.compile(r"[^\W_]+")
_END = re.compile(r"[^\w\n]*[.!?:;][\"')\]]*(?=\s|$)|[^\w\n]*\n")


def _words(text: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(text.lower()))


@cache
def _known() -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """Known sentences by their first word, longest first."""
    out: dict[str, list] = {}
    for name, sentence in SENTENCES.items():
        words = _words(sentence)
        out.setdefault(words[0], []).append((words, name))
    return {k: sorted(v, key=lambda x: -len(x[0])) for k, v in out.items()}


def sentences(text: str) -> list[tuple[str, int, int, int, int]]:
    """Known sentences of a text: identifier, first and past-last word, start and end.

    A sentence starts at the text's start, on a new line or after the end of another,
    and ends where one ends; line breaks inside it are no hindrance.
    """
    # Lower-casing one letter can give two; matching by letter keeps the offsets right.
    found = list(_TOKEN.finditer(text))
    words = [m[0].lower() for m in found]
    known, out, i, starts = _known(), [], 0, True
    ends_after = lambda k: k == len(found) - 1 or bool(_END.match(text, found[k].end()))
    while i < len(words):
        step = 1
        if starts:
            for want, name in known.get(words[i], ()):
                last = i + len(want) - 1
                if tuple(words[i : last + 1]) == want and ends_after(last):
                    out.append((name, i, last + 1, found[i].start(), found[last].end()))
                    step = len(want)
                    break
        i += step
        starts = i < len(words) and ends_after(i - 1)
    return out


def licences(text: str) -> list[tuple[str, str, int, int, int]]:
    """Licences of a text: licence, rule, start, end (code points), sentences."""
    found, out, i = sentences(text), [], 0
    while i < len(found):
        best = None
        for rule, (name, wanted) in RULES.items():
            run = found[i : i + len(wanted)]
            near = all(b[1] - a[2] <= GAP for a, b in zip(run, run[1:]))
            if tuple(x[0] for x in run) == wanted and near and (best is None or len(wanted) > best[4]):
                best = (name, rule, run[0][3], run[-1][4], len(wanted))
        if best:
            out.append(best)
        i += best[4] if best else 1
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence found: id, ``licence, rule, start, end, n_sentences``.

    * A null or empty text has none. Rows repeated with one id each give their rows, in
      text order within a row. An empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *x) for r, text in enumerate(batch.column(1)) for x in licences(text.as_py())]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))],
                names=["id", "licence", "rule", "start", "end", "n_sentences"],
            )

    rows = docs.where(F.col(text_col).rlike(HINT)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, licence string, rule string, start int, end int, n_sentences int")
    return found.withColumnRenamed("id", id_col)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
