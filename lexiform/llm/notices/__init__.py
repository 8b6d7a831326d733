"""Templates of the license scan, by SPDX identifier and kind, with their deciding words.

A name alone or ``-name`` is a statement of a sentence, ``-spdx`` an identifier line, ``-header`` what stands above
source code, ``-text`` and ``-full`` the license itself. The ``.txt`` files beside this one are license texts
as they are published.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_MIT_RIGHTS = _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_END = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ADS = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Name: (template, deciding words, which stand in the template).
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0"),
    "Apache-2.0-header": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License version 3"),
    "MIT": ("Released under the MIT License", "MIT License"),
    "MIT-text": (_MIT, "obtaining a copy of this software and associated documentation files"),
    "MIT-full": (_MIT_RIGHTS + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + _MIT_END, "above copyright notice and this permission notice shall be included in all copies"),
    "MIT-0-text": (_MIT_RIGHTS + "." + _MIT_END, "is furnished to do so the software is provided as is"),
    "BSD-2-Clause-text": (_BSD + _BSD_END, "Redistributions in binary form must reproduce"),
    "BSD-3-Clause-text": (_BSD + _BSD_NAMES + _BSD_END, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    "BSD-4-Clause-text": (_BSD + _BSD_ADS + _BSD_NAMES + _BSD_END, "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    "ISC-text": (_ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END, "provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD-text": (_ISC + "." + _ISC_END, "is hereby granted the software is provided as is"),
    "Zlib-text": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "including commercial applications and to alter it and redistribute it freely"),
    "Unlicense-text": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software released into the public domain"),
    "BSL-1.0-text": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", "accompanying documentation covered by this license"),
    "BSL-1.0-header": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License Version 1.0"),
    "MPL-2.0-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License v 2.0"),
    "MPL-1.1-header": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/", "Mozilla Public License Version 1.1"),
}
#: What a statement calls a license.
_CALLED = {
    "Apache-2.0": ["Apache License 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache License 1.1"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0"],
    "ISC": ["ISC License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
_GNU = {"GPL-1.0": ("", "1"), "GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.0": ("Library ", "2"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

for _id, (_kind, _v) in _GNU.items():
    _name = f"GNU {_kind}General Public License"
    _CALLED[_id] = [f"{_name}, version {_v}", f"{_name} v{_v}", f"{_name} {_v}", f"{_name} v{_v}.0", f"{_name}, version {_v}.0"][: 3 if "." in _v else 5]
    _start, _by = "This program is free software: you can redistribute it and/or modify it under the terms of the ", "as published by the Free Software Foundation"
    NOTICES |= {
        f"{_id}-or-later-header": (f"{_start}{_name} {_by}, either version {_v} of the License, or (at your option) any later version.", f"{_name} {_by} either version {_v} of the License or at your option any later version"),
        f"{_id}-only-header": (f"{_start}{_name} {_by}; version {_v} of the License.", f"{_name} {_by} version {_v}"),
        f"{_id}-only-header-2": (f"{_start}{_name} version {_v} {_by}.", f"{_name} version {_v} {_by}"),
    }
for _kind, _long in _CC.items():
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _id = f"CC-{_kind}-{_v}"
        NOTICES.setdefault(_id, (f"Licensed under CC {_kind} {_v}", f"CC {_kind} {_v}"))
        NOTICES[f"{_id}-name"] = (f"This work is licensed under a Creative Commons {_long} {_v} License", f"Creative Commons {_long} {_v}")
        NOTICES[f"{_id}-name-2"] = (f"Licensed under CC-{_kind}-{_v}", f"CC-{_kind}-{_v}")
NOTICES |= {"CC0-1.0": ("Licensed under CC0 1.0", "CC0 1.0")}
for _id, _names in _CALLED.items():
    for _k, _name in enumerate(_names, 1):
        _key = f"{_id}-name" + (f"-{_k}" if _k > 1 else "")
        NOTICES[_key if _id in NOTICES else _id] = (f"Licensed under the {_name}", _name)
_FILES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "CC0-1.0": "CC0 1.0 Universal",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3",
    "GPL-1.0": "GNU GENERAL PUBLIC LICENSE Version 1",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3",
    "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
    "MPL-1.1": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
_IDS = {n for i in (*_FILES, *_CALLED, "MIT", "0BSD") for n in ([f"{i}-only", f"{i}-or-later", i, f"{i}+"] if "GPL" in i or "GFDL" in i else [i])} - {"BSD"}
for _id in sorted(_IDS | {f"CC-{k}-{v}" for k in _CC for v in ("3.0", "4.0")}):
    NOTICES[f"{_id}-spdx"] = (f"SPDX-License-Identifier: {_id}", f"SPDX-License-Identifier {_id}")


@cache
def notices() -> dict[str, tuple[str, str]]:
    """All templates, with the texts of the files."""
    here = Path(__file__).parent
    return NOTICES | {f"{i}-full": ((here / f"{i}.txt").read_text("utf-8"), words) for i, words in _FILES.items()}
