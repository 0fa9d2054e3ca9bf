"""License notices and full texts to look for.  Fixed values: the licenses' own words; the full
texts are the files of ``license_full``, named like the license."""

from importlib import resources


def gnu_header(kind: str, name: str, version: str) -> str:
    """The notice that the GNU licenses ask for in each file."""
    return (f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {name} as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This "
            f"{kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")


REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.")
ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.")
ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
    "includes software developed by the organization.")

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": gnu_header("program", "GNU Affero General Public License", "3"),
    "BSD-2-Clause": REDISTRIBUTION,
    "BSD-2-Clause-name": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": f"{REDISTRIBUTION} {ENDORSEMENT}",
    "BSD-3-Clause-name": "Licensed under the BSD 3-Clause License.",
    "BSD-4-Clause": f"{REDISTRIBUTION} {ADVERTISING} {ENDORSEMENT}",
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:"),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": gnu_header("program", "GNU General Public License", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": gnu_header("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": gnu_header("library", "GNU Lesser General Public License", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
}
FULL = {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in resources.files(__package__).joinpath("license_full").iterdir()
        if f.name.endswith(".txt")}
TEMPLATES = {**NOTICES, **FULL}

GPL, LGPL, AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"
CC = "creative commons attribution"
#: The words that tell a license from others whose notices read alike: name, version and variant.  Each
#: phrase has to stand whole inside a match, in one of its forms (``|``).  Notices not named here have no
#: like one in the list but longer ones, which win by their matched words.
TELLING = {
    "AGPL-3.0": (AGPL, "version 3|v3"), "AGPL-3.0-header": (AGPL, "version 3"),
    "Apache-2.0": ("apache license version 2 0|apache license 2 0|apache license v2 0",),
    "Apache-2.0-header": ("apache license version 2 0",),
    "BSD-2-Clause-name": ("bsd 2 clause|bsd two clause",), "BSD-3-Clause": ("endorse or promote products",),
    "BSD-3-Clause-name": ("bsd 3 clause|bsd three clause",), "BSD-4-Clause": ("advertising materials", "endorse or promote products"),
    "CC-BY-4.0": (f"{CC} 4 0",), "CC-BY-NC-4.0": ("cc by nc 4 0",), "CC-BY-NC-4.0-name": (f"{CC} noncommercial 4 0",),
    "CC-BY-NC-ND-4.0": (f"{CC} noncommercial noderivatives 4 0",), "CC-BY-NC-SA-4.0": (f"{CC} noncommercial sharealike 4 0",),
    "CC-BY-ND-4.0": (f"{CC} noderivatives 4 0",), "CC-BY-SA-4.0": (f"{CC} sharealike 4 0",),
    "GPL-2.0": (GPL, "version 2|v2"), "GPL-2.0-header": (GPL, "version 2"), "GPL-3.0": (GPL, "version 3|v3"), "GPL-3.0-header": (GPL, "version 3"),
    "LGPL-2.1": (LGPL, "version 2 1|v2 1"), "LGPL-2.1-header": (LGPL, "version 2 1"), "LGPL-3.0": (LGPL, "version 3|v3"),
    "LGPL-3.0-header": (LGPL, "version 3"), "MIT": ("mit license|mit licence",),
    "MPL-2.0": ("mozilla public license v 2 0|mozilla public license version 2 0",),
    "Apache-2.0-text": ("apache license version 2 0 january 2004",), "Artistic-text": ("the artistic license",), "CC0-1.0-text": ("cc0 1 0 universal",),
    "GFDL-1.2-text": ("gnu free documentation license version 1 2",), "GFDL-1.3-text": ("gnu free documentation license version 1 3",),
    "GPL-1-text": (f"{GPL} version 1",), "GPL-2-text": (f"{GPL} version 2",), "GPL-3-text": (f"{GPL} version 3",),
    "LGPL-2-text": ("gnu library general public license version 2",), "LGPL-2.1-text": (f"{LGPL} version 2 1",), "LGPL-3-text": (f"{LGPL} version 3",),
    "MPL-1.1-text": ("mozilla public license version 1 1",), "MPL-2.0-text": ("mozilla public license version 2 0",),
}
