"""Wordings of common licenses: sentences, headers and full bodies. A bounded parameter of the license scan, not of the data's size.

A wording's name is ``license|number``. Licenses of one family are versions or relatives that share much of their text.
"""

from __future__ import annotations

import os

from wareloom.llm.license_scan import SHINGLE, TEMPLATES, plain_words

_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
_BODIES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2",
           "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
_BY_NAME = {  # license: what a sentence calls it
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MIT": ("MIT License",), "ISC": ("ISC License",), "Unlicense": ("Unlicense License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "MPL-1.1": ("Mozilla Public License, version 1.1",), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "CC0-1.0": ("Creative Commons Zero 1.0", "Creative Commons CC0 1.0 Universal"),
    **{f"{short}-{v}": (f"GNU {long} License, version {v[:-2] if v.endswith('.0') else v}", f"GNU {long} License v{v}", f"{short} version {v[:-2] if v.endswith('.0') else v}")
       for short, long, versions in (("GPL", "General Public", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public", ("2.1", "3.0")), ("LGPL", "Library General Public", ("2.0",)),
                                     ("AGPL", "Affero General Public", ("3.0",))) for v in versions},
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v} License", f"Creative Commons {long} {v} International License" if v == "4.0" else f"Creative Commons {long} {v} Unported License")
       for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                       ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
}
_SENTENCES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "under the terms of the {}",
              "This work is licensed under a {}", "This work is licensed under the {}.")
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. ')
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_TEXTS = {
    "MIT": (TEMPLATES["MIT permission"][0] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
            "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            + _WARRANTY + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (_BSD + _BSD_3 + _BSD_END,),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    **{f"{short}-{v}.0" if "." not in v else f"{short}-{v}":
       (f"it under the terms of the GNU {long} License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version",
        f"it under the terms of the GNU {long} License as published by the Free Software Foundation; either version {v} of the License.",
        f"it under the terms of the GNU {long} License version {v} as published by the Free Software Foundation")
       for short, long, versions in (("GPL", "General Public", ("2", "3")), ("LGPL", "Lesser General Public", ("2.1", "3")), ("AGPL", "Affero General Public", ("3",))) for v in versions},
}


def family(license_name: str) -> str:
    """Relatives share a family: GPL, LGPL and AGPL; the BSD licenses; those of Creative Commons; the versions of others."""
    return "GPL" if "GPL" in license_name else license_name.replace(" ", "-").split("-")[0]


def bank() -> dict[str, tuple[str, ...]]:
    """``license|number`` -> text; the scan's own notices keep their names and come first."""
    out, known = dict(TEMPLATES), {" ".join(plain_words(t)).split().__str__() for (t,) in TEMPLATES.values()}

    def add(name: str, text: str) -> None:
        words = " ".join(plain_words(text)).split()
        if len(words) >= SHINGLE and str(words) not in known:
            known.add(str(words))
            out[f"{name}|{len(out)}"] = (text,)

    for name, called in _BY_NAME.items():
        for sentence in _SENTENCES:
            for c in called:
                add(name, sentence.format(c))
    for name, texts in _TEXTS.items():
        for text in texts:
            add(name, text)
    for name, file in _BODIES.items():
        with open(os.path.join(_FOLDER, f"{file}.txt"), encoding="utf-8") as lines:
            add(name, lines.read())
    return out
