"""License scans: a digest of the canonical form of a whole text, looked up among known licences.

The canonical form has lower case, no copyright lines, no punctuation, one spelling where several are
equivalent, and single spaces. Its SHA-256 is joined to those of the known texts, which are brought to
canonical form by the same function.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, pick, slices

#: Known texts up to this number are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000

#: Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_DENIAL = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC_DENIAL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Public licence texts and notices that are whole texts of their own.
KNOWN = {
    "MIT": f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_DENIAL}",
    "MIT-0": f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_DENIAL}",
    "ISC": f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DENIAL}",
    "0BSD": f"Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_DENIAL}",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_DENIAL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN |= {
    "BSD-2-Clause": f"BSD 2-Clause License\n\n{_BSD}{_BSD_DENIAL}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\n{_BSD}{_BSD_NAMES}{_BSD_DENIAL}",
}

#: Other first lines of the same texts.
TITLES = {"MIT": ["The MIT License", "The MIT License (MIT)"], "ISC": ["The ISC License"], "0BSD": ["BSD Zero Clause License"]}
#: Whole texts that lie in files beside this module, and the names they go by.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause-UC",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
_END = "END OF TERMS AND CONDITIONS"


def all_known() -> list[tuple[str, str]]:
    """(licence, text) of all known texts: with and without their titles, with and without what follows their terms."""
    texts = KNOWN | {name: (Path(__file__).parent / "licence_texts" / f"{file}.txt").read_text() for file, name in FILES.items()}
    found = []
    for name, text in texts.items():
        title, _, body = text.strip("\n").partition("\n\n")
        forms = [text, *[f"{t}\n\n{body}" for t in TITLES.get(name, [])], *[body] * bool(body)]
        found += [(name, f) for f in forms] + [(name, f.partition(_END)[0] + _END) for f in forms if _END in f]
    return found


_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
#: Marks outside ASCII that count as punctuation.
_MARKS = "«»–—―‘’‚“”„•…"
_YEAR = r"[<\[{]?(?:[0-9]{4}\b|year\b|yyyy\b)"
#: A line that names a copyright by a mark, a year or a holder, a name that has capitals and small letters. Lines of
#: the body that begin with the word, as the wrapping has it, are none.
_COPYRIGHT = re.compile(
    rf"""(?:portions\s+)?(?:©|\(c\)[\s,]*{_YEAR}|copyright[\s:]*(?:©|\(c\)|{_YEAR}
    |(?:by\s+)?(?-i:(?!(?:Act|Notices?|Holders?|Owners?|Laws?|License|Licence|Statements?|Interests?|And|Or|In)\b)[A-Z][\w.&'-]*[a-z]))
    |all\s+rights\s+reserved[\s.!]*$)""",
    re.IGNORECASE | re.VERBOSE,
)


def canonical(text: str | None) -> str:
    """The canonical form; a null text, one of punctuation and one of copyright lines have the empty one."""
    plain = text or ""
    text = plain.lower()
    if "copyright" in text or "(c)" in text or "©" in text or "all rights reserved" in text:
        text = "\n".join(x for x in plain.split("\n") if not _COPYRIGHT.match(x.strip(" \t\r*#/;-"))).lower()
    if not text.isascii():
        for mark in _MARKS:
            text = text.replace(mark, " ")
    words = text.encode().translate(_PUNCTUATION).split()
    known = _SPELLED.get
    return b" ".join([known(w, w) for w in words]).decode()


_SPELLED = {k.encode(): v.encode() for k, v in SPELLINGS.items()}


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.record_batch([b["doc_id"], pa.array([digest(t) for t in b["text"].to_pylist()])], ["doc_id", "canonical_sha256"])


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """licence, text of the texts that come with this module, or of those given."""
    return spark.createDataFrame(all_known() if texts is None else list(texts.items()), "licence string, text string")


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, canonical_sha256, licence (null where the text is none of the known).

    Of known texts with one canonical form the first name counts; known texts whose form is empty match
    nothing, nor do null and empty texts. Repeated ids and rows keep a row each; other columns are not
    read. An empty table gives no rows.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = rows.mapInArrow(_digests, "doc_id long, canonical_sha256 string")
    names = pick(known, doc_id="licence", text="text").withColumn("doc_id", F.col("doc_id").cast("string"))
    listed = names.mapInArrow(_digests, "doc_id string, canonical_sha256 string").where(F.col("canonical_sha256") != digest(""))
    listed = listed.groupBy("canonical_sha256").agg(F.min("doc_id").alias("licence"))
    if known.count() <= MOST_BROADCAST:
        listed = F.broadcast(listed)
    return found.join(listed, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), known_licences(spark))


QUERIES = {"op4_licences": op4_licences}
ORACLES: dict[str, str] = {}
