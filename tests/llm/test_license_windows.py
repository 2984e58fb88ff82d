"""Licence statements without a marker word, wrapped over lines, and within prose."""

from windowmill.llm import license_scan

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it without restriction"""
ISC = """/*
 * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above notice appears
 */"""
PROSE = "the river ran down from the hills and nobody in the town had seen so much water in years "


def test_statements_without_marker_wrapped_and_within_prose(spark):
    texts = {
        "mit": MIT, "isc": ISC, "gpl3": GPL.format("", 3) + PROSE * 5, "gpl2": GPL.format("", 2) + PROSE * 5, "lgpl": GPL.format("Lesser ", 3), "agpl": GPL.format("Affero ", 3),
        "cc": PROSE * 20 + "Licensed under CC BY-SA 4.0 " + PROSE * 20, "none": PROSE * 40, "empty": "", "null": None,
    }
    files = spark.createDataFrame([(k, f"{k}/a.txt", t) for k, t in texts.items()], "doc_id string, path string, text string")
    found = {r.id: r.license for r in license_scan.scan(files, "doc_id", "path", "text").collect()}
    assert found == {"mit": "MIT", "isc": "ISC", "gpl3": "GPL-3.0", "gpl2": "GPL-2.0", "lgpl": "LGPL-3.0", "agpl": "AGPL-3.0", "cc": "CC-BY-SA-4.0", "none": None, "empty": None, "null": None}
