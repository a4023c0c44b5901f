"""Texts that licences are known by: full texts of short licences, the notices
that longer ones ask for, their titles and opening paragraphs, short notices and
the mark of SPDX lines; and the terms that tell near ones apart."""

from __future__ import annotations

from typing import NamedTuple

# Public licence texts and notices, by SPDX identifier.
_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_ZLIB = """
This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
_UNLICENSE = """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to http://unlicense.org
"""
_APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
_APACHE_TITLE = """
Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
_MPL = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""

# Opening paragraphs of the full texts of the longer licences.
_OPENINGS = [
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("Apache-2.0", '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'),
    ("GPL-2.0-only", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("GPL-3.0-only", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0-only", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too."),
    ("AGPL-3.0-only", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-2.1-only", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("LGPL-2.1-only", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("LGPL-3.0-only", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MPL-2.0", '1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("MPL-2.0", '1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.'),
]


class Template(NamedTuple):
    #: SPDX identifier; none for the mark of SPDX lines, which name their licence themselves.
    name: str | None
    text: str
    #: Terms that tell near licences apart: a unit is this licence only if it has all of ``needs`` and none of ``bars``.
    needs: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()


def _gnu() -> list[Template]:
    """The notices that the GNU licences ask for, of one version and of later ones, too."""
    out = []
    for short, name, own, others in (("GPL", "General Public License", (), ("lesser", "affero")), ("LGPL", "Lesser General Public License", ("lesser",), ("affero",)), ("AGPL", "Affero General Public License", ("affero",), ("lesser",))):
        for version, spoken in {"GPL": (("2.0", "2"), ("3.0", "3")), "LGPL": (("2.1", "2.1"), ("3.0", "3")), "AGPL": (("3.0", "3"),)}[short]:
            for kind, words in (("only", f"version {spoken} of the License"), ("or-later", f"either version {spoken} of the License, or (at your option) any later version")):
                thing = "library" if short == "LGPL" else "program"
                text = f"""
This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; {words}.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {thing}. If not, see https://www.gnu.org/licenses/.
"""
                later = kind == "or-later"
                needs, bars = (*own, spoken, *("later",) * later), (*others, *("later",) * (not later))
                out.append(Template(f"{short}-{version}-{kind}", text, needs, bars))
                said = f"version {spoken} or any later version" if later else f"version {spoken}"
                out.append(Template(f"{short}-{version}-{kind}", f"This {thing} is free software; you can redistribute it under the terms of the GNU {name}, {said}.", needs, bars))
                out.append(Template(f"{short}-{version}-{kind}", f"This work is licensed under the GNU {name}, {said}.", needs, bars))
                out.append(Template(f"{short}-{version}-{kind}", f"Licensed under the GNU {name}, {said}.", needs, bars))
    return out


_OTHERS = ("noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd")


def _creative(name: str, *words: str) -> list[Template]:
    """Short notices of a Creative Commons licence; ``words`` tell it from its kin."""
    code, long = "-".join(["BY", *[w for w in words if len(w) == 2]]), "".join(f"-{w}" for w in words if len(w) > 2)
    bars = tuple(w for w in _OTHERS if w.lower() not in {x.lower() for x in words})
    joined = "attribution" + long.lower()
    return [
        Template(name, f"Licensed under CC {code} 4.0.", (code.lower(),)),
        Template(name, f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License.", (joined,), bars),
    ]


TEMPLATES = [
    Template("0BSD", _ISC.replace("provided that the above copyright notice and this permission notice appear in all copies", ""), (), ("appear",)),
    Template("Apache-2.0", _APACHE),
    Template("Apache-2.0", _APACHE_TITLE),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template("BSD-2-Clause", _CONDITIONS + _BSD_DISCLAIMER, (), ("neither",)),
    Template("BSD-3-Clause", _CONDITIONS + _ENDORSE + _BSD_DISCLAIMER, ("neither",)),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ("bsd-style",)),
    *_creative("CC-BY-4.0"),
    *_creative("CC-BY-NC-4.0", "NC", "NonCommercial"),
    *_creative("CC-BY-SA-4.0", "SA", "ShareAlike"),
    *_gnu(),
    Template("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ("affero", "3")),
    Template("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("2",), ("lesser", "affero")),
    Template("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("3",), ("lesser", "affero")),
    Template("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", ("lesser", "2.1")),
    Template("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("lesser", "3")),
    Template("ISC", _ISC, ("appear",)),
    Template("MIT", _MIT),
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MPL-2.0", _MPL),
    Template("MPL-2.0", "Mozilla Public License Version 2.0", ("mozilla",)),
    Template("Unlicense", _UNLICENSE),
    Template("Zlib", _ZLIB),
    *[Template(name, text) for name, text in _OPENINGS],
    Template(None, "SPDX-License-Identifier"),
]
