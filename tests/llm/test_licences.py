"""Licence texts and headers as they stand in real files."""

from hearthgrid.llm.licenses import TEMPLATES, Scanner, terms

DF = {t: 3 for v in TEMPLATES.values() for x in v for t in terms(x)}
SCANNER = Scanner(TEMPLATES, DF, 1000, 0.7)


def wrapped(text, width, mark=""):
    w = text.split()
    return "\n".join(mark + " ".join(w[k:k + width]) for k in range(0, len(w), width))


def test_commented_header_inside_code():
    header = wrapped(TEMPLATES["GPL-3.0"][2], 9, " * ")
    text = "/*\n * Tool for grids\n * by nobody\n" + header + "\n * and more of it here\n */\n" + "\n".join(f"int v{k} = {k};" for k in range(300))
    assert SCANNER.scan(text)[1:] == ("GPL-3.0", False)


def test_long_licence_text_is_a_licence_file():
    body = "\n\n".join(wrapped(x, 11) for x in TEMPLATES["MIT"][4:])
    for text in ("MIT License\n\nCopyright (c) 2020 somebody\n\n" + body, "\n\n".join([body] * 3)):
        assert SCANNER.scan(text)[1:] == ("MIT", True)


def test_notice_inside_a_long_line():
    text = "w " * 600 + TEMPLATES["Apache-2.0"][1] + " w" * 600
    assert SCANNER.scan(text)[1:] == ("Apache-2.0", False)


def test_notice_inside_one_line_of_any_length():
    for n in (0, 10, 50, 150, 250, 3000):
        assert SCANNER.scan("word " * n + "Released under the MIT License." + " word" * n)[:2] == (SCANNER.scan("Released under the MIT License.")[0], "MIT")


def test_versions_and_identifiers():
    later = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by " \
            "the Free Software Foundation; either version {} of the License, or any later version."
    assert SCANNER.scan(later.format(2))[1] == "GPL-2.0" and SCANNER.scan(later.format(3))[1] == "GPL-3.0"
    code = "".join(f"int v{k} = {k};\n" for k in range(500))
    for name, line in (("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0", " * SPDX-License-Identifier: GPL-2.0-or-later"), ("ISC", wrapped(TEMPLATES["ISC"][0], 8, "# "))):
        assert SCANNER.scan(line + "\n" + code)[1:] == (name, False), name
    assert SCANNER.scan("// SPDX-License-Identifier: Zlib\n" + code)[1] is None


def test_whole_texts_of_many_lines():
    """A wrapped notice over more than 400 words of one licence is its file."""
    text = "\n".join(wrapped(x, 5) for x in TEMPLATES["MIT"][4:] * 4)
    assert len(text.split()) > 400 and SCANNER.scan(text)[1:] == ("MIT", True)
