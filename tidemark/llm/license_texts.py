"""Notices and short texts of public licenses, each with its deciding words.

Fixed values: wording of public notices and licenses.  Statements of one line and identifiers are made by rule.
"""

from __future__ import annotations

WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} License for more details."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"

TEXTS = [
    ("MIT", MIT, "sublicense merge"),
    ("MIT", f"{MIT} {WARRANTY}", "sublicense merge"),
    ("ISC", ISC, "fee granted"),
    ("BSD-2-Clause", BSD, "redistributions binary"),
    ("BSD-2-Clause", f"{BSD} {BSD_WARRANTY}", "redistributions binary"),
    ("BSD-3-Clause", f"{BSD} {BSD_THIRD}", "redistributions endorse promote"),
    ("BSD-3-Clause", f"{BSD} {BSD_THIRD} {BSD_WARRANTY}", "redistributions endorse promote"),
    ("Apache-2.0", APACHE, "apache 2.0"),
    ("Apache-2.0", APACHE.split(" See ")[0], "apache 2.0"),
    ("MPL-2.0", MPL, "mozilla 2.0"),
    ("MPL-2.0", MPL.split(" If ")[0], "mozilla 2.0"),
    ("Unlicense", UNLICENSE, "unencumbered"),
    ("Zlib", ZLIB, "commercial alter"),
]
# (license, name, words of it that decide)
NAMED = [
    ("MIT", "MIT License", "mit"),
    ("ISC", "ISC License", "isc"),
    ("BSD", "BSD License", "bsd"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2-clause"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3-clause"),
    ("Apache", "Apache License", "apache"),
    ("Apache-1.1", "Apache License, Version 1.1", "apache 1.1"),
    ("Apache-2.0", "Apache License, Version 2.0", "apache 2.0"),
    ("MPL-1.1", "Mozilla Public License, version 1.1", "mozilla 1.1"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla 2.0"),
    ("EPL-1.0", "Eclipse Public License, version 1.0", "eclipse 1.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0", "eclipse 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "boost 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal", "cc0 1.0"),
    ("EUPL-1.1", "European Union Public Licence, version 1.1", "european 1.1"),
    ("EUPL-1.2", "European Union Public Licence, version 1.2", "european 1.2"),
]
# Titles that full texts begin with: (license, title, words of it that decide).
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2.0 january 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "general 2 june 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "general 3 june 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lesser 2.1 february 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lesser 3 june 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "affero 3 november 2007"),
]
# Short ways to say it: (license, words, words that decide).
SHORT = [
    ("MIT", "MIT licensed", "mit licensed"),
    ("MIT", "MIT License", "mit license"),
    ("MIT", "The MIT License (MIT)", "mit license"),
    ("ISC", "ISC License", "isc license"),
    ("BSD", "BSD License", "bsd license"),
    ("BSD", "BSD licensed", "bsd licensed"),
    ("Apache-2.0", "Apache 2.0 License", "apache 2.0 license"),
    ("Apache-2.0", "Apache License 2.0", "apache license 2.0"),
    ("Apache-2.0", "Apache 2.0 licensed", "apache 2.0 licensed"),
    ("Apache-2.0", "Licensed under Apache 2.0", "apache 2.0"),
]
GNU_NAMES = [("GPL", "General Public", "general", ("2", "3")), ("LGPL", "Lesser General Public", "lesser general", ("2.1", "3")), ("AGPL", "Affero General Public", "affero general", ("3",))]
COMMONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
COMMONS_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def _templates() -> list[tuple[str, str, str]]:
    named, out = list(NAMED), [*TEXTS, *TITLES, *SHORT]
    for short, words, deciding, versions in GNU_NAMES:
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            # GPLv2, GPL v2, GPL version 2
            out += [(name, f"{short}v{v}", f"{short}v{v}".lower()), (name, f"{short} {v}", f"{short} {v}".lower()), (name, f"{short} version {v}", f"{short} {v}".lower())]
            named.append((name, f"GNU {words} License, version {v}", f"gnu {deciding} {v}"))
            notice = GNU.format(words, v, words)
            out += [(name, notice, f"gnu {deciding} {v}"), (name, notice.split(" This program is distributed")[0], f"gnu {deciding} {v}")]
    for kind in COMMONS:
        parts = [COMMONS_WORDS[x] for x in kind.split("-")]
        for v in ("2.0", "2.5", "3.0", "4.0"):
            named.append((f"CC-{kind}-{v}", f"CC {kind} {v}", f"cc {kind.lower()} {v}"))
            # The variants are written with hyphens, as one word, or apart.
            for written in dict.fromkeys(("-".join(parts), " ".join(parts))):
                named.append((f"CC-{kind}-{v}", f"Creative Commons {written} {v}", f"creative {written.lower()} {v}"))
    for name, words, deciding in named:
        verbs = ("Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under a {}") if "License" in words else ("Licensed under {}", "This work is licensed under a {} International License")
        out += [(name, verb.format(words), deciding) for verb in verbs]
        if len(words.split()) > 3 or words.startswith("CC"):
            out.append((name, words, deciding))
    for name in dict.fromkeys(n for n, *_ in [*named, *TEXTS]):
        if name not in ("BSD", "Apache"):
            out.append((name, f"SPDX-License-Identifier: {name}", f"spdx-license-identifier {name.lower()}"))
            # An identifier with a version is a word of its own that nothing else is written as.
            out += [(name, f"Licensed under {name}", name.lower())] if "." not in name else [(name, name, name.lower())]
    return out


TEMPLATES = _templates()
