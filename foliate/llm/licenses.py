"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, cut, map_arrow

# Public licence texts and notices, by SPDX identifier.
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_WARRANTY = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."


def gnu(name: str, version: str, date: str) -> list[str]:
    notice, warranty = GNU.format(name, version), GNU_WARRANTY.format(name)
    plain = f"GNU {name}"
    return [notice, f"{notice} {warranty}", f"{plain} Version {version}, {date}", f"{plain} Version {version}", f"Licensed under the {plain}, version {version}", f"This work is licensed under the {plain}, version {version}"]


def commons(code: str, name: str) -> list[str]:
    return [f"Licensed under {code} 4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", f"Creative Commons {name} 4.0 International Public License"]


TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", APACHE, f"Licensed under the Apache License, Version 2.0 (the \"License\"); {APACHE} {APACHE_WARRANTY}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause Simplified License", f"{BSD} {BSD_WARRANTY}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause New or Revised License", BSD_NAMES, f"{BSD} {BSD_NAMES} {BSD_WARRANTY}"],
    "CC-BY-4.0": commons("CC BY", "Attribution"),
    "CC-BY-NC-4.0": commons("CC BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": commons("CC BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["Licensed under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "GPL-2.0": gnu("General Public License", "2", "June 1991"),
    "GPL-3.0": gnu("General Public License", "3", "29 June 2007"),
    "AGPL-3.0": gnu("Affero General Public License", "3", "19 November 2007"),
    "LGPL-3.0": gnu("Lesser General Public License", "3", "29 June 2007"),
    "ISC": ["Licensed under the ISC License", ISC, f"{ISC} {ISC_WARRANTY}"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", MIT_GRANT, f"{MIT_GRANT} {MIT_NOTICE} {WARRANTY}"],
    "MPL-2.0": ["Licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["Released under the Unlicense", UNLICENSE],
}


def with_identifiers(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """``templates``, and for each name the line by which a file names it."""
    ends = lambda n: ("", "-only", "-or-later") if "GPL" in n else ("",)
    return {n: [*t, *[f"SPDX-License-Identifier: {n}{e}" for e in ends(n)]] for n, t in templates.items()}


#: A line that holds one of these may belong to a header.
TRIGGER = r"(?i)licen[cs]|copyright|public domain|permission|redistribution|spdx"
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)(\.[^/]*)?$"
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


class Matcher:
    """Cosine of a text's TF-IDF vector to each template's; terms of no template weigh most."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        rows = [(name, terms(t)) for name, texts in with_identifiers(templates).items() for t in texts]
        df = Counter(w for _, c in rows for w in c)
        self.idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        self.other = math.log(1 + len(rows)) + 1
        self.names = [name for name, _ in rows]
        self.holders: dict[str, list[tuple[int, float]]] = {}  # of a term: template and weight
        for k, (_, c) in enumerate(rows):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            for w, n in c.items():
                self.holders.setdefault(w, []).append((k, n * self.idf[w] / norm))

    def best(self, text: str) -> tuple[float, str]:
        """The largest cosine and its template's name; of equals the first name. Without a shared term 0 and no name."""
        v = {w: n * self.idf.get(w, self.other) for w, n in terms(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        dots: dict[int, float] = {}
        for w, x in v.items():
            for k, y in self.holders.get(w, ()):
                dots[k] = dots.get(k, 0.0) + x * y
        return min(((x / norm, self.names[k]) for k, x in dots.items()), key=lambda s: (-round(s[0], 9), s[1]), default=(0.0, ""))


def windows(text: str) -> list[str]:
    """The whole text, and each run of one to three lines that are not blank."""
    lines = [x for x in text.split("\n") if x.strip()]
    return [text, *[" ".join(lines[i : i + n]) for i in range(len(lines)) for n in (1, 2, 3) if i + n <= len(lines)]]


def headers(text: str | None, trigger: re.Pattern) -> list[str]:
    """Each line with a trigger, each run of such lines, and each paragraph that holds one (lines between blank ones, comment signs apart)."""
    out, run, paragraph, held = [], [], [], 0
    for line in [*(text or "").split("\n"), ""]:
        if trigger.search(line):
            run.append(line)
            held += 1
        else:
            out += run
            if len(run) > 1:
                out.append(" ".join(run))
            run = []
        if WORD.search(line.lower()):
            paragraph.append(line)
        else:
            if held and len(paragraph) > held:
                out.append(" ".join(paragraph))
            paragraph, held = [], 0
    return out


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """(id, path, licence, score, is_file) of each row with a header at ``least`` cosine or more from a template.

    Every line of the whole text is looked at; the best header counts, of equals
    the first identifier. ``is_file``: the name is that of a licence file, of
    which the whole and every run of one to three lines are compared too. Null
    and empty texts have no header; rows that share an id are scanned each;
    other columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, trigger = Matcher(templates), re.compile(TRIGGER)
        for whole in batches:
            for b in by_bytes(whole, "text"):
                keep, licence, score = [], [], []
                for i, (text, is_file) in enumerate(zip(b.column("text").to_pylist(), b.column("is_file").to_pylist(), strict=True)):
                    found = [matcher.best(h) for h in [*(windows(text) if is_file else []), *headers(text, trigger)]]
                    found = [f for f in found if f[0] >= least]
                    if found:
                        top = min(found, key=lambda f: (-round(f[0], 9), f[1]))
                        keep.append(i)
                        score.append(top[0])
                        licence.append(top[1])
                if keep:
                    x = b.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([x.column("id"), x.column("path"), pa.array(licence), pa.array(score), x.column("is_file")], ["id", "path", "licence", "score", "is_file"])

    named = F.coalesce(F.col(path_col).rlike(FILE_NAME), F.lit(False))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), named.alias("is_file")).where(F.col("text").rlike(TRIGGER))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, path string, licence string, score double, is_file boolean")


def directory(path: str) -> Column:
    """Everything before the last slash; empty for a path without one."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherit(files: DataFrame, found: DataFrame, id_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """A row for each file with a licence: id, path, licence, score, how, licence_dir.

    A file's own header counts first (how: header, or file for a licence file);
    any other file takes the licence of the nearest directory, its own or one
    above, with a licence file (of several the best score, then the first
    identifier). Directories are joined by path, each once however many files it
    holds. A null path has no directory and inherits nothing.
    """
    owner = found.where("is_file and path is not null").select(directory("path").alias("owner"), "licence", "score")
    owner = owner.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("score"), "licence"))).where("r = 1").drop("r")
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path")).withColumn("dir", F.when(F.col("path").isNotNull(), directory("path")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("owner")))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("up")).select("dir", "up.*")
    near = dirs.join(owner, "owner").groupBy("dir").agg(F.max_by(F.struct("owner", "licence", "score"), "depth").alias("from"))
    own = found.select("id", "path", "licence", "score", F.when(F.col("is_file"), "file").otherwise("header").alias("how"), F.lit(None).cast("string").alias("licence_dir"))
    named = found.select(F.col("id").alias("own_id")).distinct()
    rest = rows.join(near, "dir").join(named, F.col("id").eqNullSafe(F.col("own_id")), "left_anti")
    rest = rest.select("id", "path", F.col("from.licence").alias("licence"), F.col("from.score").alias("score"), F.lit("inherited").alias("how"), F.col("from.owner").alias("licence_dir"))
    return own.unionByName(rest).withColumnRenamed("id", id_col).withColumnRenamed("path", path_col)


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """``inherit`` over what ``scan`` finds. Null texts have no header; rows that share an id share their state; an empty table gives no rows."""
    return inherit(files, cut(scan(files, id_col, path_col, text_col, templates, least)), id_col, path_col)
