"""License scans by ordered signature rules.

A text is reduced to lower-case words with one space between them. A rule is a regular expression over that string,
with a keyword that must occur, a priority and a weight. Detections are taken in order of priority, then length, then
start; one that lies inside the interval of a detection already taken is suppressed.

Rules that stand for one license each are written one by one: IDENTIFIERS, BODIES (sentences of license texts and notices) and
ADDRESSES. How a license is named (FAMILIES) is joined with the ways in which running text refers to one (FORMS, and LATER for
licenses that come in versions).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import map_batches

#: Fixed by the contract: phrases that every scan counts.
PHRASES = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

_V = r"(?: version| v)?"
#: After an abbreviation, which may be joined with its version.
_N = r"(?: version| v|v)?"
_CC = "(?:1 0|2 0|2 5|3 0|4 0)"
#: e with or without an acute accent, in one character or two; only A-Z are in lower case here.
_E = "(?:e(?:\u0301)?|\u00e9|\u00c9)"
#: label, keyword, name as a regular expression over normalised words; several rows may share a label. Each match of a name has
#: a word that begins with its keyword.
FAMILIES = (
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public license{_V} 3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl{_N} ?3(?: 0)?"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public license{_V} 3(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public license{_V} 2(?: 1)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{_N} ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{_N} ?2(?: 1)?"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public license{_V} 3(?: 0)?"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public license{_V} 2(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public license"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{_N} ?3(?: 0)?"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{_N} ?2(?: 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?: version 1 [123])?"),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license)?{_N} ?2(?: 0)?"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)?{_V} 1 1"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: license)?"),
    ("bsd-2-clause", "freebsd", r"freebsd(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: license)?"),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) licen[sc]e"),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd (?:4|four) clause)(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl-2.0", "mozilla", rf"mozilla public license{_V} 2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V} 1 1"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("mpl-2.0", "mpl", rf"mpl{_V} ?2(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public license{_V} 2(?: 0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public license{_V} 1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl-1.0", "distribution", rf"common development and distribution license(?:{_V} 1(?: [01])?)?"),
    ("cpl-1.0", "common", rf"common public license(?:{_V} 1(?: 0)?)?"),
    ("eupl-1.2", "european", rf"european union public licen[sc]e(?:{_V} 1 [12])?"),
    ("artistic-2.0", "artistic", rf"artistic license{_V} 2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", rf"boost software license(?:{_V} 1(?: 0)?)?"),
    ("busl-1.1", "business", rf"business source license(?:{_V} 1 1)?"),
    ("sspl-1.0", "server", rf"server side public license(?:{_V} 1)?"),
    ("elastic-2.0", "elastic", rf"elastic license(?:{_V} 2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python", rf"python(?: software foundation)? license(?:{_V} 2(?: 0)?)?"),
    ("ofl-1.1", "font", rf"(?:sil )?open font license(?:{_V} 1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("upl-1.0", "permissive", r"universal permissive license"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database license"),
    ("odc-by", "commons", r"open data commons attribution license"),
    ("ogl-uk", "government", rf"open government licen[sc]e(?:{_V} [123](?: 0)?)?"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"(?:creative commons )?cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"(?:creative commons )?cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"(?:creative commons )?cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"(?:creative commons )?cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"(?:creative commons )?cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"(?:creative commons )?cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc", "creative", r"creative commons"),
    ("reserved", "rights", r"all rights (?:are )?reserved"),
    ("reserved", "droits", rf"tous droits r{_E}serv\S*"),
    ("reserved", "vorbehalten", r"alle rechte vorbehalten"),
    ("reserved", "derechos", r"todos los derechos reservados"),
    ("public-domain", "domain", r"public domain"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|software|license)"),
)

#: form, regular expression around a name {0}, priority (low first) and weight.
FORMS = (
    ("grant", r"(?:is |are |be )?(?:licensed|released|distributed|published|available|provided|redistributed|covered|shared)(?: \S+){{0,3}} under (?:the |an? )?(?:terms of )?(?:the |an? )?{0}", 1, 0.95),
    ("terms", r"(?:under|subject to|according to|in accordance with) (?:the )?terms (?:and conditions )?of (?:the |an? )?{0}", 2, 0.9),
    ("heading", r"license {0}", 3, 0.8),
    ("mention", r"(?:the )?{0}", 4, 0.5),
)
#: A form of its own for licenses with versions, and those licenses.
LATER = ("later", r"{0} (?:or|and) (?:\(at your option\) )?(?:at your option )?(?:any later version|later)", 2, 0.9)
VERSIONED = frozenset(("agpl", "agpl-3.0", "apache-2.0", "epl-1.0", "epl-2.0", "gfdl", "gpl", "gpl-2.0", "gpl-3.0", "lgpl", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "mpl-1.1", "mpl-2.0"))

#: label, keyword and identifier, as it stands behind "SPDX-License-Identifier:" in normalised words.
IDENTIFIERS = (
    ("0bsd", "0bsd", r"0bsd"),
    ("afl-3.0", "afl", r"afl 3 0"),
    ("agpl-1.0", "agpl", r"agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "agpl", r"agpl 3 0(?: only| or later)?"),
    ("apache-1.0", "apache", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache 2 0"),
    ("apsl-2.0", "apsl", r"apsl 2 0"),
    ("artistic-1.0", "artistic", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic 2 0"),
    ("blueoak-1.0.0", "blueoak", r"blueoak 1 0 0"),
    ("bsd-1-clause", "bsd", r"bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause patent"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause"),
    ("bsd-3-clause-clear", "bsd", r"bsd 3 clause clear"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause"),
    ("bsl-1.0", "bsl", r"bsl 1 0"),
    ("busl-1.1", "busl", r"busl 1 1"),
    ("cc-by", "cc", rf"cc by {_CC}"),
    ("cc-by-nc", "cc", rf"cc by nc {_CC}"),
    ("cc-by-nc-nd", "cc", rf"cc by nc nd {_CC}"),
    ("cc-by-nc-sa", "cc", rf"cc by nc sa {_CC}"),
    ("cc-by-nd", "cc", rf"cc by nd {_CC}"),
    ("cc-by-sa", "cc", rf"cc by sa {_CC}"),
    ("cc0-1.0", "cc0", r"cc0 1 0"),
    ("cddl-1.0", "cddl", r"cddl 1 0"),
    ("cddl-1.1", "cddl", r"cddl 1 1"),
    ("cecill-2.1", "cecill", r"cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"),
    ("cpl-1.0", "cpl", r"cpl 1 0"),
    ("ecl-2.0", "ecl", r"ecl 2 0"),
    ("elastic-2.0", "elastic", r"elastic 2 0"),
    ("epl-1.0", "epl", r"epl 1 0"),
    ("epl-2.0", "epl", r"epl 2 0"),
    ("eupl-1.1", "eupl", r"eupl 1 1"),
    ("eupl-1.2", "eupl", r"eupl 1 2"),
    ("ftl", "ftl", r"ftl"),
    ("gfdl", "gfdl", r"gfdl 1 [123](?: only| or later)?"),
    ("gpl-1.0", "gpl", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl 3 0(?: only| or later)?"),
    ("hpnd", "hpnd", r"hpnd"),
    ("ijg", "ijg", r"ijg"),
    ("ipl-1.0", "ipl", r"ipl 1 0"),
    ("isc", "isc", r"isc"),
    ("lgpl-2.0", "lgpl", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"lgpl 3 0(?: only| or later)?"),
    ("lppl-1.3c", "lppl", r"lppl 1 3c"),
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mit 0"),
    ("mpl-1.0", "mpl", r"mpl 1 0"),
    ("mpl-1.1", "mpl", r"mpl 1 1"),
    ("mpl-2.0", "mpl", r"mpl 2 0"),
    ("ms-pl", "ms", r"ms pl"),
    ("ms-rl", "ms", r"ms rl"),
    ("mulanpsl-2.0", "mulanpsl", r"mulanpsl 2 0"),
    ("ncsa", "ncsa", r"ncsa"),
    ("odbl-1.0", "odbl", r"odbl 1 0"),
    ("odc-by", "odc", r"odc by 1 0"),
    ("ofl-1.1", "ofl", r"ofl 1 1"),
    ("openssl", "openssl", r"openssl"),
    ("osl-3.0", "osl", r"osl 3 0"),
    ("pddl-1.0", "pddl", r"pddl 1 0"),
    ("php-3.01", "php", r"php 3 01"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2.0", "python", r"python 2 0"),
    ("sspl-1.0", "sspl", r"sspl 1 0"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl-1.0", "upl", r"upl 1 0"),
    ("vim", "vim", r"vim"),
    ("w3c", "w3c", r"w3c"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib"),
    ("zpl-2.1", "zpl", r"zpl 2 1"),
)

#: label, keyword and a sentence of a license text or of the notice that goes with it.
BODIES = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "machine", r"solely in the form of machine executable object code generated by a source language processor"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "irrevocable", r"a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache", "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "warranty", r"this program comes with absolutely no warranty"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-2.0", "take", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.0", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", "supplemented", r"supplemented by the additional permissions listed below"),
    ("agpl-3.0", "interacting", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "form", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "accompanying", r"the accompanying program is provided under the terms of this common public license"),
    ("eupl-1.2", "eupl", r"licensed under the eupl version 1 2(?: or as soon they will be approved by the european commission)?"),
    ("artistic", "package", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "standard", r"you may distribute verbatim forms of the source form of the standard version of this package"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", r"you just do what the fuck you want to"),
    ("python-2.0", "python", r"psf is making python available to licensee on an as is basis"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("ms-pl", "accept", r"if you use the software you accept this license if you do not accept the license do not use the software"),
    ("upl-1.0", "freely", r"any and all copyright rights in the software and any and all patent rights owned or freely licensable"),
    ("ncsa", "restriction", r"deal with the software without restriction including without limitation the rights to use"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", "agreement", r"without a written agreement is hereby granted provided that the above copyright notice"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:\S+ ){0,6}the freetype project"),
    ("busl-1.1", "production", r"use of the licensed work in production is(?: not)? permitted"),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", "share", r"you are free to share (?:and|or) (?:to )?(?:adapt|remix)"),
    ("cc-by-nc", "purposes", r"you may not use the material for commercial purposes|for noncommercial purposes only"),
    ("cc-by-nd", "derivatives", r"you may not distribute the modified material or derivatives"),
    ("odbl-1.0", "database", r"this database is made available under the open database license"),
    ("odc-by", "database", r"this database is made available under the open data commons attribution license"),
    ("public-domain", "dedicated", r"(?:is|are|has been|hereby) dedicated to the public domain"),
    ("public-domain", "placed", r"(?:is|are|has been|hereby) placed in the public domain"),
    ("public-domain", "rights", r"no rights reserved"),
    ("reserved", "rights", r"some rights reserved"),
    ("proprietary", "confidential", r"this (?:document|file|software|material) (?:is|contains) (?:proprietary and )?confidential"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:\S+ ){0,8}strictly prohibited"),
    ("proprietary", "express", r"without the (?:prior )?express(?:ed)? written (?:consent|permission) of"),
    ("proprietary", "eula", r"end user license agreement eula"),
)

#: label, keyword and address, in normalised words.
ADDRESSES = (
    ("agpl-3.0", "gnu", r"gnu org licenses agpl(?: 3 0)?"),
    ("apache-2.0", "apache", r"apache org licenses(?: license 2 0)?"),
    ("artistic-2.0", "opensource", r"opensource org licenses? artistic(?: license)? 2 0"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource", r"opensource org licenses? bsd license(?: php)?"),
    ("bsl-1.0", "boost", r"boost org license 1 0"),
    ("cc-by", "creativecommons", rf"creativecommons org licenses by {_CC}"),
    ("cc-by-nc", "creativecommons", rf"creativecommons org licenses by nc {_CC}"),
    ("cc-by-nc-nd", "creativecommons", rf"creativecommons org licenses by nc nd {_CC}"),
    ("cc-by-nc-sa", "creativecommons", rf"creativecommons org licenses by nc sa {_CC}"),
    ("cc-by-nd", "creativecommons", rf"creativecommons org licenses by nd {_CC}"),
    ("cc-by-sa", "creativecommons", rf"creativecommons org licenses by sa {_CC}"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cddl-1.0", "opensource", r"opensource org licenses? cddl 1 0"),
    ("ecl-2.0", "opensource", r"opensource org licenses? ecl 2 0"),
    ("elastic-2.0", "elastic", r"elastic co licensing elastic license"),
    ("epl-1.0", "eclipse", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl 2 0"),
    ("eupl-1.2", "joinup", r"joinup ec europa eu (?:\S+ ){0,4}eupl"),
    ("gfdl", "gnu", r"gnu org (?:licenses|copyleft) fdl"),
    ("gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", r"gnu org licenses gpl 3 0"),
    ("gpl", "gnu", r"gnu org (?:licenses|copyleft) gpl"),
    ("isc", "opensource", r"opensource org licenses? isc"),
    ("lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("mit", "opensource", r"opensource org licenses? mit(?: license)?(?: php)?"),
    ("mpl-1.1", "mozilla", r"mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla org (?:en us )?mpl 2 0"),
    ("ms-pl", "opensource", r"opensource org licenses? ms pl"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?"),
    ("ofl-1.1", "scripts", r"scripts sil org ofl"),
    ("php-3.01", "php", r"php net license 3 01"),
    ("python-2.0", "python", r"docs python org (?:\S+ ){0,2}license"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("upl-1.0", "opensource", r"opensource org licenses? upl"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("zlib", "zlib", r"zlib net zlib license"),
)


@dataclass(frozen=True)
class Signature:
    label: str
    form: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    weight: float


@dataclass(frozen=True)
class Detection:
    """start and end count words, the end exclusive."""

    label: str
    form: str
    start: int
    end: int
    priority: int
    weight: float


@lru_cache(maxsize=1)
def signatures() -> dict[bytes, tuple[Signature, ...]]:
    """The rules by keyword. A name with more to it comes before its shorter one: its detection is longer."""
    out: dict[bytes, list[Signature]] = {}

    def rule(label: str, form: str, keyword: str, pattern: str, priority: int, weight: float) -> None:
        made = re.compile(f"(?<= )(?:{pattern})(?= )".encode())
        out.setdefault(keyword.encode(), []).append(Signature(label, form, keyword.encode(), made, priority, weight))

    for label, keyword, name in IDENTIFIERS:
        rule(label, "identifier", keyword, f"spdx license identifier (?:{name})", 0, 1.0)
    for label, keyword, sentence in BODIES:
        rule(label, "body", keyword, sentence, 1, 0.9)
    for label, keyword, address in ADDRESSES:
        rule(label, "address", keyword, f"(?:https? )?(?:www )?(?:{address})", 1, 0.9)
    for label, keyword, name in FAMILIES:
        for form, around, priority, weight in (*FORMS, *([LATER] if label in VERSIONED else [])):
            rule(label, form, keyword, around.format(f"(?:{name})"), priority, weight)
    return {k: tuple(v) for k, v in out.items()}


#: Fixed by the contract: what ends a word; A-Z become lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> bytes:
    """Lower-case words of a UTF-8 text, one space before, between and after them."""
    found = text.translate(_TABLE).split()
    return b" " + b" ".join(found) + b" " if found else b" "


def phrase_starts(text: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase's words stand consecutively."""
    wanted, out, at, seen, counted = b" " + phrase + b" ", [], 0, 0, 0
    while (at := text.find(wanted, at)) >= 0:
        seen += text.count(b" ", counted, at)
        counted = at
        out.append(seen)
        at += 1
    return out


def detect(text: bytes) -> list[Detection]:
    """Detections in a normalised text, suppressed ones left out, by start."""
    hits = [(r, m.start(), m.end()) for keyword, rules in signatures().items() if b" " + keyword in text for r in rules for m in r.pattern.finditer(text)]
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    # The word that starts at an offset has as many spaces before it, less the one that begins the text.
    places = np.searchsorted(spaces, np.array([h[1:] for h in hits]) + [-1, 0])
    found = [Detection(r.label, r.form, start, end, r.priority, r.weight) for (r, _, _), (start, end) in zip(hits, places.tolist())]
    found.sort(key=lambda d: (d.priority, d.start - d.end, d.start, d.label))
    return sorted(_uncontained(found), key=lambda d: (d.start, d.end, d.label))


def _uncontained(found: list[Detection]) -> list[Detection]:
    """Detections in the order given, but for those that lie inside one taken before.

    A binary indexed tree over the starts holds the farthest end of those taken.
    """
    starts = sorted({d.start for d in found})
    ends, taken = [-1] * (len(starts) + 1), []
    for d in found:
        at = k = bisect_right(starts, d.start)
        farthest = -1
        while k:
            farthest = max(farthest, ends[k])
            k &= k - 1
        if farthest < d.end:
            taken.append(d)
            while at <= len(starts):
                ends[at] = max(ends[at], d.end)
                at += at & -at
    return taken


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_words, base (array of label and start), detections and score.

    Places of the fixed phrases are all in base; detections are those of the rules. score is 1 minus the product of 1 minus
    weight over the detections' labels, 0 without any. Null and empty texts have no words. Repeated rows give repeated rows, an
    empty table an empty result, other columns are left out.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, bases, found, scores = [], [], [], []
            for raw in (x.as_py() for x in batch.column(1)):
                t = normalised(raw or b"")
                counts.append(len(t) > 1 and t.count(b" ") - 1 or 0)
                base = [(label, s) for phrase, label in PHRASES for s in phrase_starts(t, phrase)]
                ds = detect(t)
                best: dict[str, float] = {}
                for d in ds:
                    best[d.label] = max(best.get(d.label, 0.0), d.weight)
                for label, _ in base:
                    best.setdefault(label, 0.5)
                rest = 1.0
                for label in sorted(best):
                    rest *= 1 - best[label]
                bases.append([{"label": a, "start": s} for a, s in base])
                found.append([{"label": d.label, "form": d.form, "start": d.start, "end": d.end, "weight": d.weight} for d in ds])
                scores.append(1 - rest)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))), pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))), pa.array(scores, pa.float64())], ["key", "n_words", "base", "detections", "score"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    schema = f"key {kind}, n_words long, base array<struct<label:string,start:long>>, detections array<struct<label:string,form:string,start:long,end:long,weight:double>>, score double"
    return map_batches(rows, schema, make).withColumnRenamed("key", key)
