"""Ordered signature rules: one row per rule, made from families and forms.

A family has a label, the keyword (a whole word) that must stand in a text before any of its rules is tried, and a
pattern of its name in normalised words (ASCII lower case, one space between words).  Every name that the
pattern takes holds the keyword, so a joined spelling has a row of its own.  Each form wraps
that name into one kind of notice.  Longer forms have the higher priority: a full notice says more than
a bare mention inside it.  A name that is also an everyday word (``WORDLIKE``) is a mention only beside a
second cue.  Sentences of license texts and file headers, and addresses, are rules of their own.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rank: int
    priority: int
    weight: float
    label: str
    keyword: str
    pattern: str


#: label, keyword, name; written by hand.
FAMILIES = [
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version)? 2(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)"),
    ("bsd-0-clause", "bsd", r"(?:bsd zero clause|zero clause bsd)"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
    ("gpl-1.0", "general", r"gnu general public licen[cs]e(?: version)? 1(?: 0)?"),
    ("gpl-2.0", "general", r"gnu general public licen[cs]e(?: version)? 2(?: 0)?"),
    ("gpl-3.0", "general", r"gnu general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl v?3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: 0)?"),
    ("gpl-2.0", "gpl2", r"(?:gnu )?gpl2(?: 0)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: 0)?"),
    ("gpl-3.0", "gpl3", r"(?:gnu )?gpl3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl v?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl v?3(?: 0)?"),
    ("lgpl-2.0", "lgplv2", r"(?:gnu )?lgplv2(?: 0)?"),
    ("lgpl-2.0", "lgpl2", r"(?:gnu )?lgpl2(?: 0)?"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1"),
    ("lgpl-2.1", "lgpl2", r"(?:gnu )?lgpl2 1"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?"),
    ("lgpl-3.0", "lgpl3", r"(?:gnu )?lgpl3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e(?: version)? 2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl v?3(?: 0)?"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3(?: 0)?"),
    ("agpl-3.0", "agpl3", r"(?:gnu )?agpl3(?: 0)?"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e(?: version)? 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version)? 2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl v?2(?: 0)?"),
    ("mpl-2.0", "mplv2", r"mplv2(?: 0)?"),
    ("mpl-2.0", "mpl2", r"mpl2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: version)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: version)? 2(?: 0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: version)? 1(?: 0)?"),
    ("eupl-1.1", "eupl", r"eupl(?: version)? v?1 1"),
    ("eupl-1.2", "eupl", r"eupl(?: version)? v?1 2"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version)? 1 2"),
    ("cddl-1.0", "cddl", r"cddl(?: version)? 1 0"),
    ("cddl-1.1", "cddl", r"cddl(?: version)? 1 1"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: version)? 1(?: 0)?"),
    ("cddl-1.0", "common", r"common development and distribution licen[cs]e(?: version)? 1 0"),
    ("artistic-1.0", "artistic", r"artistic(?: licen[cs]e)?(?: version)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic(?: licen[cs]e)?(?: version)? 2(?: 0)?"),
    ("zlib", "zlib", r"zlib"),
    ("libpng", "libpng", r"libpng"),
    ("boost-1.0", "boost", r"boost software(?: licen[cs]e)?(?: version)?(?: 1(?: 0)?)?"),
    ("bsl-1.1", "business", r"business source(?: licen[cs]e)?(?: version)? 1 1"),
    ("sspl-1.0", "side", r"server side public(?: licen[cs]e)?(?: version)?(?: 1(?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2.0", "python", r"python(?: software foundation)?(?: licen[cs]e)?(?: version)? 2(?: 0)?"),
    ("php-3.01", "php", r"php(?: licen[cs]e)?(?: version)? 3 01"),
    ("ruby", "ruby", r"ruby"),
    ("perl", "perl", r"perl"),
    ("openssl", "openssl", r"openssl"),
    ("ofl-1.1", "font", r"sil open font(?: licen[cs]e)?(?: version)? 1 1"),
    ("ofl-1.1", "ofl", r"ofl(?: version)? 1 1"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-4.0", "cc", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("odbl-1.0", "odbl", r"odbl(?: version)?(?: 1 0)?"),
    ("odbl-1.0", "database", r"open database(?: licen[cs]e)?(?: version)?(?: 1 0)?"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl", "pddl", r"pddl(?: 1 0)?"),
    ("llama", "llama", r"llama(?: [23])?(?: community)?"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail m?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("afl-3.0", "academic", r"academic free(?: licen[cs]e)?(?: version)? 3(?: 0)?"),
    ("osl-3.0", "osl", r"osl(?: version)? 3(?: 0)?"),
]

#: Labels whose names are also everyday words, or names of languages and bodies.
WORDLIKE = {"isc", "ruby", "perl", "llama"}

#: What may stand between an SPDX mark and an operand of its expression, the operator before it included.
_OPERANDS = r"spdx licen[cs]e identifier [a-z0-9 ]{{1,80}} (?:or|and) "

#: name of the form, priority, weight, pattern around the family's name.
FORMS = [
    ("mention", 10, 0.6, r"(?:the )?{name} licen[cs]ed?\b"),
    ("identifier", 30, 0.95, r"spdx licen[cs]e identifier {name}(?: or later| only)?\b"),
    ("operand", 30, 0.95, r"(?={name}\b)(?<=" + _OPERANDS + r"){name}(?: or later| only)?\b"),
    ("grant", 40, 0.9, r"(?:re)?(?:licen[cs]ed|released|distributed|available|published|provided)(?: \w+){{0,3}}? under(?: the)?(?: terms of)?(?: the)? {name}\b(?: licen[cs]e)?(?: or(?: \(at your option\))? (?:any )?later(?: version)?)?"),
    ("file", 20, 0.7, r"(?:see|read)(?: the)? {name} licen[cs]e(?: \w+){{0,2}}? (?:file|text|terms)\b"),
    ("address", 35, 0.9, r"(?:opensource org|spdx org|choosealicense com) licen[cs]es? {name}\b"),
]

#: The mention of a name in ``WORDLIKE``: a verb or a noun of licensing must stand beside it.
CUED_MENTION = (r"(?:(?:under|per|see|read|terms of|subject to|covered by)(?: the)? {name} licen[cs]e\b"
                r"|(?:the )?{name} licen[cs]e (?:text|terms|file|agreement|version|applies|permits|grants|requires)\b)")

#: Notices without a family: label, keyword, priority, weight, pattern.
NOTICES = [
    ("proprietary", "rights", 25, 0.7, r"all rights reserved\b"),
    ("proprietary", "proprietary", 25, 0.8, r"proprietary(?: and)? confidential\b"),
    ("public-domain", "domain", 25, 0.8, r"(?:released|dedicated|placed)(?: \w+){0,3}? public domain\b"),
    ("mit", "permission", 60, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy\b"),
    ("isc", "permission", 60, 1.0, r"permission to use copy modify and or distribute this software for any purpose\b"),
    ("bsd", "redistribution", 60, 1.0, r"redistribution and use in source and binary forms with or without modification\b"),
    ("zlib", "warranty", 60, 0.9, r"this software is provided as is without any express or implied warranty\b"),
    ("gpl", "redistribute", 60, 1.0, r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e\b"),
    ("apache-2.0", "apache", 60, 1.0, r"you may not use this file except in compliance with the licen[cs]e\b"),
    ("unknown-license", "under", 1, 0.3, r"licen[cs]ed? under\b"),

    # headers of files
    ("gpl-2.0", "general", 70, 1.0, r"under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2\b"),
    ("gpl-3.0", "general", 70, 1.0, r"under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3\b"),
    ("lgpl-2.1", "lesser", 70, 1.0, r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2 1\b"),
    ("lgpl-3.0", "lesser", 70, 1.0, r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3\b"),
    ("lgpl-2.0", "library", 70, 1.0, r"under the terms of the gnu library general public licen[cs]e\b"),
    ("agpl-3.0", "affero", 70, 1.0, r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation (?:either )?version 3\b"),
    ("apache-2.0", "apache", 60, 1.0, r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements\b"),
    ("mpl-2.0", "mozilla", 70, 1.0, r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0\b"),
    ("mpl-1.1", "mozilla", 70, 1.0, r"contents of this file are subject to the mozilla public licen[cs]e version 1 1\b"),
    ("cddl-1.0", "common", 70, 1.0, r"contents of this file are subject to the terms of the common development and distribution licen[cs]e\b"),
    ("epl-2.0", "eclipse", 70, 1.0, r"accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:version |v )?2 0\b"),
    ("epl-1.0", "eclipse", 70, 1.0, r"accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:version |v )?1 0\b"),
    ("bsd", "bsd", 45, 0.8, r"governed by a bsd style licen[cs]e\b"),
    # sentences of license texts
    ("mit", "permission", 60, 0.9, r"above copyright notice and this permission notice shall be included in all copies or substantial portions of the software\b"),
    ("boost-1.0", "permission", 70, 1.0, r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation\b"),
    ("bsd-3-clause", "permission", 60, 0.9, r"used to endorse or promote products derived from this software without specific prior written permission\b"),
    ("bsd-4-clause", "advertising", 60, 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment\b"),
    ("zlib", "misrepresented", 60, 1.0, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software\b"),
    ("unlicense", "unencumbered", 60, 1.0, r"free and unencumbered software released into the public domain\b"),
    ("cc0-1.0", "deed", 60, 1.0, r"the person who associated a work with this deed has dedicated the work to the public domain\b"),
    ("ofl-1.1", "font", 60, 1.0, r"goals of the open font licen[cs]e ofl are to stimulate worldwide development\b"),
    ("python-2.0", "python", 60, 1.0, r"this licen[cs]e agreement is between the python software foundation psf\b"),
    ("isc", "permission", 60, 0.9, r"with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies\b"),
    ("gpl-2.0", "june", 60, 0.9, r"gnu general public licen[cs]e version 2 june 1991\b"),
    ("gpl-3.0", "copyleft", 60, 0.9, r"gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works\b"),
    # addresses
    ("apache-2.0", "apache", 35, 0.9, r"apache org licen[cs]es licen[cs]e 2 0\b"),
    ("gpl-2.0", "gnu", 35, 0.9, r"gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0\b"),
    ("gpl-3.0", "gnu", 35, 0.9, r"gnu org licen[cs]es gpl 3 0\b"),
    ("lgpl-2.1", "gnu", 35, 0.9, r"gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1\b"),
    ("lgpl-3.0", "gnu", 35, 0.9, r"gnu org licen[cs]es lgpl 3 0\b"),
    ("agpl-3.0", "gnu", 35, 0.9, r"gnu org licen[cs]es agpl 3 0\b"),
    ("mpl-2.0", "mozilla", 35, 0.9, r"mozilla org (?:en us )?mpl 2 0\b"),
    ("cc-by", "creativecommons", 35, 0.9, r"creativecommons org licen[cs]es by [1-4] [05]\b"),
    ("cc-by-sa", "creativecommons", 35, 0.9, r"creativecommons org licen[cs]es by sa [1-4] [05]\b"),
    ("cc-by-nd", "creativecommons", 35, 0.9, r"creativecommons org licen[cs]es by nd [1-4] [05]\b"),
    ("cc-by-nc", "creativecommons", 35, 0.9, r"creativecommons org licen[cs]es by nc [1-4] [05]\b"),
    ("cc-by-nc-sa", "creativecommons", 35, 0.9, r"creativecommons org licen[cs]es by nc sa [1-4] [05]\b"),
    ("cc-by-nc-nd", "creativecommons", 35, 0.9, r"creativecommons org licen[cs]es by nc nd [1-4] [05]\b"),
    ("cc0-1.0", "creativecommons", 35, 0.9, r"creativecommons org publicdomain zero 1 0\b"),
    # identifiers that no other word looks like
    ("gpl-2.0", "gpl", 15, 0.8, r"gpl 2 0 (?:only|or later)\b"),
    ("gpl-3.0", "gpl", 15, 0.8, r"gpl 3 0 (?:only|or later)\b"),
    ("lgpl-2.1", "lgpl", 15, 0.8, r"lgpl 2 1 (?:only|or later)\b"),
    ("lgpl-3.0", "lgpl", 15, 0.8, r"lgpl 3 0 (?:only|or later)\b"),
    ("agpl-3.0", "agpl", 15, 0.8, r"agpl 3 0 (?:only|or later)\b"),
]


#: A text without any of these matches no rule: every form and notice holds one of them.
ANCHORS = ["licen", "spdx", "under", "rights", "proprietary", "domain", "permission",
           "redistribut", "warranty", "gpl", "mpl", "advertising", "misrepresented"]


def rules() -> list[Rule]:
    out = [(priority, weight, label, keyword,
            r"\b" + (CUED_MENTION if kind == "mention" and label in WORDLIKE else form).format(name=name))
           for kind, priority, weight, form in FORMS for label, keyword, name in FAMILIES]
    out += [(priority, weight, label, keyword, r"\b" + pattern) for label, keyword, priority, weight, pattern in NOTICES]
    return [Rule(i, *x) for i, x in enumerate(out)]
