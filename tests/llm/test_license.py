import math
import os
import re
from collections import Counter

import pytest

from tidemark.llm import license

SYSTEM = "/usr/share/common-licenses"
FILES = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "GPL-1": "GPL-1.0", "Apache-2.0": "Apache-2.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}
HEADERS = {
    "GPL-3.0": "/* x.c\n * Copyright (C) 2020 A\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint x;",
    "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n",
    "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n',
    "MIT": "x\n// SPDX-License-Identifier: MIT\ny",
    "LGPL-2.1": "// SPDX-License-Identifier: LGPL-2.1-or-later",
    "BSD-2-Clause": "\n".join("# " + x for x in re.findall(r".{1,70}(?: |$)", dict(license.TERMS)["BSD-2-Clause"].replace("\n", " "))),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def found(spark, files):
    return {r["path"]: r for r in license.scan(spark.createDataFrame(files, "path string, text string")).collect()}


def test_headers_over_several_lines(spark):
    got = found(spark, [(f"{name}.c", text) for name, text in HEADERS.items()])
    assert {p.removesuffix(".c"): r["license"] for p, r in got.items()} == {name: name for name in HEADERS}


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no licence texts on this machine")
def test_licence_files(spark):
    files = [(f"{name}/LICENSE", open(f"{SYSTEM}/{name}", encoding="utf-8", errors="replace").read()) for name in FILES if os.path.exists(f"{SYSTEM}/{name}")]
    got = found(spark, files)
    assert {p.split("/")[0]: r["license"] for p, r in got.items()} == {name: FILES[name] for name, _ in ((p.split("/")[0], 0) for p, _ in files)}


def brute_force(path, text):
    if path is None or text is None:
        return None, None
    low = text.lower()
    lines, segments = low.split("\n"), []
    for i, line in enumerate(lines):
        if any(c in line for c in license.CUES):
            segments += [lines[max(i - b, 0) : i + a + 1] for b, a in license.WINDOWS]
        if any(c in line for c in license.OPENINGS):
            segments.append(lines[i : i + license.OPENING + 1])
    if re.search(license.LICENSE_NAME, path.split("/")[-1]) and any(c in low for c in license.CUES):
        segments.append([low])
    best = []
    for s in segments:
        bag = Counter(re.findall(license.TOKEN, "\n".join(s)))
        norm = math.sqrt(sum((n * license._IDF.get(t, license._IDF_OTHER)) ** 2 for t, n in bag.items()))
        for i, (name, _) in enumerate(license.TEMPLATES):
            dot = sum(bag[t] * license._IDF[t] * w for j, _, t, w in license._ROWS if j == i)
            if norm and round(dot / norm, 6) >= license.THRESHOLD:
                best.append((name in license.GENERIC, -round(dot / norm, 6), name))
    return (min(best)[2], -min(best)[1]) if best else (None, None)


def test_own_licences_are_those_of_brute_force(spark):
    """Ties, repeated paths and rows, nulls, empty and long texts, and columns of clashing names."""
    long = "word " * 20_000 + "\nReleased under the MIT License.\n" + "x\n" * 2000
    files = [("a.c", "All rights reserved.\nReleased under the MIT License."), ("b.c", "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0."), ("c", None), ("d", ""), (None, "All rights reserved."), ("e/COPYING", "hello copyright\nGNU General Public License, version 2"), ("f", long), ("a.c", "All rights reserved.\nReleased under the MIT License.")]
    table = spark.createDataFrame([(p, t, "x", "y") for p, t in files], "path string, text string, license string, score string")
    got = license.scan(table).collect()
    assert len(got) == len(files)
    for r in got:
        assert (r["own_license"], r["own_score"]) == next(brute_force(p, t) for p, t in files if p == r["path"])
    assert license.scan(table.where("false")).collect() == []
