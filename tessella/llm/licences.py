"""Known licences, as texts: the default digests of the licence scan.

Full texts beyond the short ones here are files of ``licence_texts``, named by
licence. One-line notices are a fixed set of phrases around the names of a general
list of licences.
"""

from __future__ import annotations

from pathlib import Path

# Licence texts and notices, and spellings that count as equal.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
_FIRST = (
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD2),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
)
#: Names of licences in one-line notices.
NAMES = {
    "MIT": ("MIT", "MIT License"),
    "ISC": ("ISC", "ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache 2.0", "Apache-2.0 License", "Apache License 2.0", "Apache License, Version 2.0"),
    "MPL-1.1": ("MPL 1.1", "Mozilla Public License 1.1", "Mozilla Public License, version 1.1"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "BSL-1.0": ("BSL 1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal"),
} | {
    f"{short}-{v}": (f"{short} {v}", f"{short}v{v[0] if v.endswith('.0') else v}", f"{name} {v}", f"{name}, version {v}", f"{name} version {v}") + ((f"{name}, version {v[0]}", f"{name} version {v[0]}", f"{name} v{v[0]}") if v.endswith(".0") else ())
    for short, name, versions in (
        ("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
        ("AGPL", "GNU Affero General Public License", ("3.0",)), ("GFDL", "GNU Free Documentation License", ("1.2", "1.3")),
    )
    for v in versions
} | {
    f"CC-{short}-{v}": (f"CC {short} {v}", f"Creative Commons {short} {v}", f"Creative Commons {name} {v}", *(f"Creative Commons {name} {v} {where}{tail}" for where in {"4.0": ("International",), "3.0": ("Unported",)}.get(v, ("Generic",)) for tail in ("", " License")), f"Creative Commons {name} {v} License")
    for short, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
    for v in ("2.0", "2.5", "3.0", "4.0")
}
_SUBJECTS = ("", "This work is ", "This project is ", "This program is ", "This software is ")


def _notices() -> list[tuple[str, str]]:
    out = []
    for licence, names in NAMES.items():
        for name in names:
            long = name.startswith("GNU") or "License" in name
            articles = (("a ", "the ") if licence.startswith("CC") else ("the ",)) if long else ("", "the ")
            out += [(licence, f"{who}{how} under {article}{name}.") for article in articles for who in _SUBJECTS for how in ("licensed", "released")]
        out.append((licence, f"SPDX-License-Identifier: {licence}"))
    return out


def _full_texts() -> list[tuple[str, str]]:
    """Each text file, and what comes before its appendix; BSD and MIT texts with and without their titles."""
    out = [("MIT", MIT.removeprefix("MIT License\n")), ("MIT", "The " + MIT)]
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        licence, text = path.stem.removesuffix("-regents"), path.read_text("utf-8")
        out.append((licence, text))
        head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(licence, head + end), (licence, head)]
        if licence == "BSD-3-Clause":
            out += [(licence, title + text) for title in ("BSD 3-Clause License\n", "The 3-Clause BSD License\n")]
    return out


KNOWN = (*_FIRST, *_full_texts(), *_notices())
EQUAL_WORDS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright  owner", "copyright  holder"),
    ("copyright  owners", "copyright  holders"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non  commercial", "noncommercial"),
    ("non  infringement", "noninfringement"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per  cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub  license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
