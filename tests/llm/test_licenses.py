"""Whole licences in the layouts in which they come."""

import os

import pytest

from tidemark.llm import licenses

COMMON = "/usr/share/common-licenses"

ISC = """ISC License

Copyright 2004-2010 Ann Smith
Copyright Bob Jones and others

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED “AS IS” AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""

WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD = """
Copyright (c) 2020, Ann Smith
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
{2} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def cases():
    mit = max((t for i, t in licenses.KNOWN if i == "MIT"), key=len)
    curly = mit.replace('"AS IS"', "“AS IS”").replace(", ", ", ").replace("\n\n", "\n\n• ")
    out = [("MIT", curly), ("ISC", ISC)]
    for marks in (("1.", "2.", "3."), ("*", "*", "*"), ("•", "•", "•")):
        for title in ("", "BSD 2-Clause License\n"):
            out.append(("BSD-2-Clause", title + (BSD + WARRANTY).format(*marks)))
        for title in ("", "BSD 3-Clause License\n"):
            out.append(("BSD-3-Clause", title + (BSD + THIRD + WARRANTY).format(*marks)))
    return out


def common():
    """The system's copies, whole and up to the end of their terms."""
    end = "END OF TERMS AND CONDITIONS"
    for name, id_ in {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        if os.path.exists(f"{COMMON}/{name}"):
            text = open(f"{COMMON}/{name}", encoding="utf-8").read()
            yield id_, text
            if end in text:
                yield id_, text[: text.index(end) + len(end)]


def identified(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return [r.license_id for r in sorted(got, key=lambda r: r.id)]


def test_usual_layouts(spark):
    want = cases()
    assert identified(spark, [t for _, t in want]) == [i for i, _ in want]
    assert identified(spark, [ISC + "\nand more", BSD, "Copyright 2020 Ann", "software"]) == [None] * 4


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no copies of licences")
def test_whole_texts(spark):
    want = list(common())
    curly = [(i, t.replace('"', "”").replace("'", "’").replace(" ", " ")) for i, t in want]
    assert identified(spark, [t for _, t in want + curly]) == [i for i, _ in want + curly]
