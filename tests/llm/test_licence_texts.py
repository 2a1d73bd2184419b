"""Wrapped headers, tags and whole licence files; none of the wordings here
is a template as it stands."""

from __future__ import annotations

import pytest

from mercato.llm import licences

GPL = """/* frob.c - part of frob
 *
 * Copyright (C) 2019 Somebody
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General
 * Public License as published by the Free Software
 * Foundation, either version {v} of the License, or (at your option)
 * any later version.
 */
int main(void) {{ return 0; }}
"""
MIT = """MIT License

Copyright (c) 2021 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """   Copyright 2020 The Frob Authors

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0
"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla
# Public License, v. 2.0. If a copy of the MPL was not
# distributed with this file, You can obtain one at
# https://mozilla.org/MPL/2.0/.
x = 1
"""


def scan(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return {r["path"]: (r["licence"], r["found"]) for r in licences.scanned(df).collect()}


@pytest.mark.parametrize("text, licence", [
    (GPL.format(v=3), "GPL-3.0"), (GPL.format(v=2), "GPL-2.0"),
    (GPL.format(v=3).replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
    (MIT, "MIT"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"),
    ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"),
    ("; SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("Mozilla Public License Version 2.0\n==================\n", "MPL-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n            Version 3, 29 June 2007\n\n"
     " Everyone is permitted to copy this document.\n", "GPL-3.0")])
def test_headers_tags_and_titles(spark, text, licence):
    assert scan(spark, [("a/file", text)])["a/file"] == (licence, "statement")


def test_licence_files_give_their_directory(spark):
    got = scan(spark, [("p/LICENSE", MIT), ("p/src/deep/a.c", "int a;"), ("q/COPYING.txt", APACHE),
                       ("q/b.c", "int b;"), ("r/notes.txt", " ".join(f"note{i}x" for i in "abcdefghijklmnopqrstuvwxyz" * 1) + " " + " ".join("abcdefghijklmnopqrstuvwxyz") + "\n" + MPL),
                       ("r/c.c", "int c;"), ("s/plain", "free software is fine, they say, version 3")])
    assert got["p/src/deep/a.c"] == ("MIT", "inherited") and got["q/b.c"] == ("Apache-2.0", "inherited")
    assert got["r/notes.txt"] == ("MPL-2.0", "statement") and got["r/c.c"] == (None, None)
    assert got["s/plain"] == (None, None)
