"""Public wordings by which works name their licenses: notices, file headers and clauses."""

from __future__ import annotations

# Notices, headers and clauses as the licenses' publishers give them. A name is the
# license, then the form where a license has several.
TEXTS = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                       "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
                       "of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                         "in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-header-end": "Unless required by applicable law or agreed to in writing, software distributed under the "
                             "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                             "either express or implied. See the License for the specific language governing permissions "
                             "and limitations under the License.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                            "provided that the following conditions are met: 1. Redistributions of source code must retain "
                            "the above copyright notice, this list of conditions and the following disclaimer. "
                            "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                            "conditions and the following disclaimer in the documentation and/or other materials provided "
                            "with the distribution.",
    "bsd-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "bsd-clause-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and "
                         "the following disclaimer.",
    "bsd-clause-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                         "and the following disclaimer in the documentation and/or other materials provided with the "
                         "distribution.",
    "bsd-3-clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                          "or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                      "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                      "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
               "this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
               "2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation; either version 2 of the "
                      "License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the "
                      "License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
                    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
                    "License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                       "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                       "the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                       "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                       "License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                      "associated documentation files, to deal in the Software without restriction",
    "mit-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                   "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                   "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                   "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                   "subject to the following conditions: The above copyright notice and this permission notice shall be "
                   "included in all copies or substantial portions of the Software.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
                      "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                 "binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
            "held liable for any damages arising from the use of this software.",
}
# Words without which a wording names another license.
NEEDED = {
    "agpl-3.0-header": "affero 3", "apache-2.0": "apache 2", "apache-2.0-header": "apache 2", "bsl-1.0": "boost",
    "cc-by-4.0": "cc by 4", "cc-by-4.0-notice": "attribution 4", "cc-by-nc-4.0": "cc nc 4",
    "cc-by-nc-4.0-notice": "noncommercial 4", "cc-by-sa-4.0": "sharealike 4", "cc0-1.0": "waived", "epl-2.0": "eclipse 2",
    "gpl-2.0": "general 2", "gpl-2.0-header": "general 2", "gpl-3.0": "general 3", "gpl-3.0-header": "general 3",
    "isc": "provided copies", "lgpl-2.1-header": "lesser 2 1", "lgpl-3.0": "lesser 3", "lgpl-3.0-header": "lesser 3",
    "mit": "mit", "mpl-2.0": "mozilla 2",
}
# Identifiers of the SPDX list that a file's one-line tag may carry.
SPDX = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
        "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")


def templates() -> list[tuple[str, str, str]]:
    """Name, wording and needed words of every template; tags are made from the identifiers."""
    known = [(name, text, NEEDED.get(name, "")) for name, text in TEXTS.items()]
    return known + [(f"{name.lower()}-tag", f"SPDX-License-Identifier: {name}", f"spdx {name}") for name in SPDX]
