"""Licence templates: notices, standard headers and short licence texts, as published. Fixed values."""

from __future__ import annotations

TEMPLATES: dict[str, tuple[str, str]] = {
    # id: (licence, text)
    "apache-2.0-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2.0-short": ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    "apache-2.0-header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-licensed": ("MIT", "Licensed under the MIT License."),
    "mit-project": ("MIT", "This project is licensed under the terms of the MIT license."),
    "mit-permission": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    "mit-condition": ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mit-warranty": ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    "gpl-3.0-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-3.0-licensed": ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    "gpl-3.0-header": ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "gpl-2.0-header": ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "gpl-warranty": ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "agpl-3.0-header": ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mpl-2.0-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "bsd-redistribution": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "bsd-style": ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "isc-permission": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "zlib-warranty": ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "cc0-1.0": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "cc-by-4.0-line": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-sa-4.0-line": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc-4.0-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-nd-4.0-line": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    "cc-by-nc-sa-4.0-line": ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    "cc-by-4.0": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "rights-reserved": ("Proprietary", "All rights reserved."),
    "bsd-source-clause": ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-binary-clause": ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-names-clause": ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-warranty": ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    "isc-warranty": ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    "zlib-permission": ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    "unlicense-grant": ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "apache-2.0-title": ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "gpl-3.0-title": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "gpl-2.0-title": ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "lgpl-2.1-title": ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "agpl-3.0-title": ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
}


def _whole(*parts: str) -> str:
    return " ".join(TEMPLATES[p][1] for p in parts)


#: Whole texts and headers, of their parts in order.
TEMPLATES |= {
    "mit-text": ("MIT", _whole("mit-permission", "mit-condition", "mit-warranty")),
    "gpl-3.0-notice": ("GPL-3.0-or-later", _whole("gpl-3.0-header", "gpl-warranty")),
    "gpl-2.0-notice": ("GPL-2.0-or-later", _whole("gpl-2.0-header", "gpl-warranty")),
    "bsd-2-clause-text": ("BSD-2-Clause", _whole("bsd-redistribution", "bsd-source-clause", "bsd-binary-clause", "bsd-warranty")),
    "bsd-3-clause-text": ("BSD-3-Clause", _whole("bsd-redistribution", "bsd-source-clause", "bsd-binary-clause", "bsd-names-clause", "bsd-warranty")),
    "isc-text": ("ISC", _whole("isc-permission", "isc-warranty")),
    "zlib-text": ("Zlib", _whole("zlib-warranty", "zlib-permission")),
}
