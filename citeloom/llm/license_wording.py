"""The wording of public licences and their notices, as templates for ``licenses``.

Markup: ``[[ ... ]]`` is wording that may be left out, nested or not; ``<<name 1-12>>`` stands for one
to twelve words of any kind; all else is mandatory. Case and punctuation don't matter.
"""

from __future__ import annotations

# Phrases and their labels.
PHRASES = (
    ("mit", "under the MIT license"),
    ("apache-2", "Apache License Version 2"),
    ("cc-by-nc", "CC BY NC"),
)

# The texts and notices of public licences.
TEMPLATES = (
    (
        "mit",
        """[[The]] [[MIT License]] [[Copyright [[(c)]] <<holder 1-20>> [[All rights reserved]]]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all
        copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<holders 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    ),
    ("mit", "[[This <<work 1-3>> is]] released under the [[terms of the]] MIT license"),
    (
        "isc",
        """[[ISC License]] [[Copyright [[(c)]] <<holder 1-20>>]]
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<author 1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    ),
    (
        "0bsd",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND <<author 1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    ),
    (
        "bsd-2",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<holder 1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED""",
    ),
    (
        "bsd-3",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. [[3]] Neither the name of <<holder 1-20>> [[nor the names of <<its 1-2>> contributors]]
        may be used to endorse or promote products derived from this software without specific prior written permission""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will <<the authors 1-12>> be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at [[http[[s]] www.apache.org/licenses/LICENSE-2.0]]
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied""",
    ),
    ("apache-2", "[[This <<work 1-3>> is]] licensed under the [[terms of the]] Apache License [[Version]] 2[[.0]]"),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    ),
    (
        "gpl-2-or-later",
        """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version""",
    ),
    (
        "gpl-3-or-later",
        """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    ),
    (
        "lgpl-or-later",
        """is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version <<number 1-2>> of the License, or (at your option)
        any later version""",
    ),
    (
        "agpl-3-or-later",
        """is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version""",
    ),
    ("gpl-2", "licensed under [[the terms of]] [[the]] GNU General Public License [[v]] [[version]] 2"),
    ("gpl-3", "licensed under [[the terms of]] [[the]] GNU General Public License [[v]] [[version]] 3"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means""",
    ),
    (
        "bsl-1",
        """[[Boost Software License - Version 1.0 [[- August 17th, 2003]]]] Permission is hereby granted, free of charge, to any
        person or organization obtaining a copy of the software and accompanying documentation covered by this license""",
    ),
    ("cc-by-4", "licensed under [[a]] [[the]] CC BY 4.0"),
    ("cc-by-4", "licensed under [[a]] [[the]] Creative Commons Attribution 4.0 [[International]] [[License]]"),
    ("cc-by-sa-4", "licensed under [[a]] [[the]] CC BY SA 4.0"),
    ("cc-by-sa-4", "licensed under [[a]] [[the]] Creative Commons Attribution ShareAlike 4.0 [[International]] [[License]]"),
    ("cc-by-nc-4", "licensed under [[a]] [[the]] CC BY NC 4.0"),
    ("cc-by-nc-4", "licensed under [[a]] [[the]] Creative Commons Attribution NonCommercial 4.0 [[International]] [[License]]"),
    ("cc0-1", "To the extent possible under law <<who 1-12>> has waived all copyright and related or neighboring rights to"),
    ("spdx", "SPDX License Identifier <<name 1-4>>"),
    ("all-rights-reserved", "Copyright [[(c)]] <<year and holder 1-12>> All rights reserved"),
)
