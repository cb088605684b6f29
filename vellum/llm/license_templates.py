"""What licences are told by: their texts, usual notices and names.

The texts stand as published beside this module, one file for each identifier.
"""

from __future__ import annotations

from pathlib import Path

#: Names by which a licence is referred to.
NAMES = {
    "MIT": ("MIT License", "MIT license terms"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL version 3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL version 2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "Artistic-1.0-Perl": ("Artistic License 1.0",),
    "Unlicense": ("The Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: How a work refers to a licence.
PHRASES = (
    "{}", "licensed under the {}", "released under the {}", "distributed under the {}", "available under the {}", "published under the {}",
    "this work is licensed under the {}", "this project is licensed under the terms of the {}", "this software is licensed under the {}",
    "content is available under {} unless otherwise noted", "use of this source code is governed by the {}",
)
#: Notices that works carry in place of the text.
NOTICES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
#: Notices of the GNU licences: what is licensed, the licence, its version.
GNU = {
    "GPL-3.0": ("program", "GNU General Public License", "3"),
    "GPL-2.0": ("program", "GNU General Public License", "2"),
    "LGPL-3.0": ("library", "GNU Lesser General Public License", "3"),
    "LGPL-2.1": ("library", "GNU Lesser General Public License", "2.1"),
    "AGPL-3.0": ("program", "GNU Affero General Public License", "3"),
}
GRANT = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, "
    "either version {2} of the License, or (at your option) any later version."
)
NO_WARRANTY = (
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the {1} for more details. You should have received a copy of the {1} along with this {0}. If not, see http://www.gnu.org/licenses/."
)
#: Words that the opening of a text has at least.
OPENING = 40


def opening(text: str) -> str:
    """The first paragraphs of a text, headings and copyright lines aside."""
    out: list[str] = []
    for part in text.split("\n\n"):
        if sum(map(len, (p.split() for p in out))) >= OPENING:
            break
        if len(part.split()) >= 12 or out:
            out.append(part)
    return " ".join(out)


def templates() -> list[tuple[str, str]]:
    """``(identifier, text)``: references by every phrase and name, notices, and each
    text whole and by its opening."""
    found = []
    for name, titles in NAMES.items():
        found += [(name, p.format(t)) for t in titles for p in PHRASES] + [(name, f"SPDX-License-Identifier: {name}")]
        found += [(name, t) for t in NOTICES.get(name, ())]
        if name in GNU:
            found += [(name, GRANT.format(*GNU[name])), (name, f"{GRANT} {NO_WARRANTY}".format(*GNU[name]))]
        path = Path(__file__).with_name("licences") / f"{name}.txt"
        if path.exists():
            text = path.read_text(encoding="utf-8")
            found += [(name, text), (name, opening(text))]
    return found
