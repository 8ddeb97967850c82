"""Licence scans: published notices as they are wrapped, odd spacing, and the SQL over the same texts."""

from __future__ import annotations

import duckdb
import pytest

from gridloom.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
NOTICES = {"MIT": MIT, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("version 3", "version 2"), "MPL-2.0": MPL, "ISC": ISC}
NOTICES |= {"AGPL-3.0-or-later": GPL.replace("GNU General", "GNU Affero General"), "LGPL-3.0-or-later": GPL.replace("GNU General", "GNU Lesser General").replace("program", "library")}
ODD = ["All rights  reserved.", "All\nrights\nreserved", "All Rights-Reserved.", "All rights\nreserved.", "(c) 2020 X. All rights reserved. Next.", "ALL RIGHTS RESERVED", "allrightsreserved"]
COMMENTS = ("# ", "// ", " * ", "-- ", "; ")


def both(spark, texts, **options):
    """Rows of the operator, which must equal those of its SQL."""
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == con.execute(licenses.oracle(**options) + " ORDER BY doc_id").fetchall()
    return got


@pytest.mark.parametrize("style", range(2))
def test_published_notices_plain_and_as_comments(spark, style):
    for name, notice in NOTICES.items():
        texts = ["\n".join(mark + x for x in notice.split("\n")) for mark in COMMENTS] if style else [notice, notice.replace("\n", "\r\n"), "Words before.\n\n" + notice + "\n\nWords behind."]
        for row in both(spark, texts):
            assert (row[3], row[4]) == (name, 0), (name, row)


def test_tags_name_their_licence(spark):
    rows = both(spark, [f"// SPDX-License-Identifier: {x}\nint main();" for x in licenses.SPDX])
    assert [r[3] for r in rows] == list(licenses.SPDX) and {r[1] for r in rows} == {1}


def test_odd_spacing(spark):
    rows = both(spark, [*ODD, "", "v. 2.0; x: y", "rights reserved", "All rights reserved"])
    assert [r[3] for r in rows[:6]] == ["Proprietary"] * 6 and rows[6][3] == "" and rows[10][3] == "Proprietary"


def test_every_known_sentence_is_found_however_its_words_are_parted(spark):
    for gap in (" ", "  ", "-", "\t", " (\"", "\n"):
        # A line that begins with a number may begin a list.
        known = sorted(s for s in licenses.SENTENCES if gap != "\n" or not any(c.isdigit() for c in s))
        rows = both(spark, [gap.join(s.split(" ")) for s in known])
        assert [r[2] for r in rows] == [licenses.SENTENCES[s] for s in known], gap


def test_sentences_of_the_caller(spark):
    own = {"use it as you like": "free-use", "a b": "short"}
    rows = both(spark, ["Use it as  you like. A b. All rights reserved.", "nothing"], sentences=own, rules=(("Free", ("free-use",)),))
    assert [r[1:] for r in rows] == [(2, "free-use,short", "Free", 1), (0, "", "", 0)]
