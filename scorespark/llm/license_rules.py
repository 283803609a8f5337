"""The ordered rules of the license scan: fixed values, written by hand.

A rule is (label, gate, pattern). Patterns run over words (lower case, joined by single blanks); gate is a word that every
match contains. Rules come in the order of their tiers and, inside a tier, of their priority.
"""

from __future__ import annotations

#: Tiers, the strongest first: a declared tag, a grant or notice, a name with its version, a name, a general clause.
TAG, GRANT, VERSIONED, NAMED, GENERIC = range(5)

#: A version of words: "2 0", "v2", "version 3 0".
V = r"(?:version |v )?v?\d{1,2}(?: \d{1,2})?(?: (?:only|or later|or newer|or greater|or any later version))?"

TAGS = (
    ("apache", "spdx", r"spdx license identifier apache 2 0(?: with llvm exception)?"),
    ("apache", "spdx", r"spdx license identifier apache 1 [01]"),
    ("mit", "spdx", r"spdx license identifier mit"),
    ("mit-0", "spdx", r"spdx license identifier mit 0"),
    ("isc", "spdx", r"spdx license identifier isc"),
    ("0bsd", "spdx", r"spdx license identifier 0bsd"),
    ("bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause(?: clear| attribution)?"),
    ("bsd-4-clause", "spdx", r"spdx license identifier bsd 4 clause(?: uc)?"),
    ("gpl", "spdx", r"spdx license identifier gpl [123] 0(?: only| or later)?(?: with (?:\S+ ){1,4}exception(?: [123] [01])?)?"),
    ("lgpl", "spdx", r"spdx license identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("agpl", "spdx", r"spdx license identifier agpl [13] 0(?: only| or later)?"),
    ("gfdl", "spdx", r"spdx license identifier gfdl 1 [123](?: invariants| no invariants)?(?: only| or later)?"),
    ("mpl", "spdx", r"spdx license identifier mpl [12] [01](?: no copyleft exception)?"),
    ("epl", "spdx", r"spdx license identifier epl [12] 0"),
    ("cddl", "spdx", r"spdx license identifier cddl 1 [01]"),
    ("eupl", "spdx", r"spdx license identifier eupl 1 [012]"),
    ("artistic", "spdx", r"spdx license identifier artistic [12] 0(?: perl| cl8)?"),
    ("boost", "spdx", r"spdx license identifier bsl 1 0"),
    ("busl", "spdx", r"spdx license identifier busl 1 1"),
    ("cc0", "spdx", r"spdx license identifier cc0 1 0"),
    ("cc-by", "spdx", r"spdx license identifier cc by [1234] [05]"),
    ("cc-by-sa", "spdx", r"spdx license identifier cc by sa [1234] [05]"),
    ("cc-by-nd", "spdx", r"spdx license identifier cc by nd [1234] [05]"),
    ("cc-by-nc", "spdx", r"spdx license identifier cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "spdx", r"spdx license identifier cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "spdx", r"spdx license identifier cc by nc nd [1234] [05]"),
    ("ofl", "spdx", r"spdx license identifier ofl 1 [01]"),
    ("odbl", "spdx", r"spdx license identifier odbl 1 0"),
    ("osl", "spdx", r"spdx license identifier osl [123] [01]"),
    ("afl", "spdx", r"spdx license identifier afl [123] [012]"),
    ("php", "spdx", r"spdx license identifier php 3 0?[01]"),
    ("python", "spdx", r"spdx license identifier (?:python|psf) 2 0"),
    ("zlib", "spdx", r"spdx license identifier zlib"),
    ("unlicense", "spdx", r"spdx license identifier unlicense"),
    ("wtfpl", "spdx", r"spdx license identifier wtfpl"),
    ("ncsa", "spdx", r"spdx license identifier ncsa"),
    ("openssl", "spdx", r"spdx license identifier openssl"),
    ("postgresql", "spdx", r"spdx license identifier postgresql"),
    ("curl", "spdx", r"spdx license identifier curl"),
    ("x11", "spdx", r"spdx license identifier x11"),
    ("mulan", "spdx", r"spdx license identifier mulanpsl [12] 0"),
    ("cecill", "spdx", r"spdx license identifier cecill(?: [bc])?(?: [12] [01])?"),
    ("ms-pl", "spdx", r"spdx license identifier ms pl"),
    ("ms-rl", "spdx", r"spdx license identifier ms rl"),
    ("upl", "spdx", r"spdx license identifier upl 1 0"),
    ("blueoak", "spdx", r"spdx license identifier blueoak 1 0 0"),
    ("sspl", "spdx", r"spdx license identifier sspl 1 0"),
    ("elastic", "spdx", r"spdx license identifier elastic 2 0"),
    ("none", "spdx", r"spdx license identifier (?:none|noassertion)"),
    ("other", "spdx", r"spdx license identifier licenseref \S+"),
)

GRANTS = (
    # MIT, ISC, X11 and their kin
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "mit", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e"),
    ("mit", "mit", r"licen[sc]e mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?"),
    ("isc", "fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e"),
    ("isc", "appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("hpnd", "supporting", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("curl", "holder", r"the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("postgresql", "written", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("upl", "larger", r"to deal in both the software and any piece of software and or hardware listed in the larger works"),
    ("blueoak", "blueoak", r"blueoak council"),
    # BSD
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:\S+ ){1,12}(?:nor|or) the names of (?:its|any|the) contributors may be used to endorse"),
    ("bsd-3-clause", "endorse", r"the names? of (?:the author|its contributors|the contributors) may not be used to endorse"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display(?: the following acknowledge?ment)?"),
    ("bsd-2-clause-views", "views", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-patent", "patent", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants (?:\S+ ){1,20}patent license"),
    ("bsd", "bsd", r"(?:licensed|released|distributed|available|governed) (?:under|by) (?:a |the )?(?:terms of (?:the )?)?bsd(?: style)? licen[sc]e"),
    ("bsd", "bsd", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    # Apache
    ("apache", "apache", r"licensed under the apache license version 2 0(?: the license)?"),
    ("apache", "apache", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache", "apache", r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "governing", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "basis", r"distributed under the license is distributed on an as is basis"),
    ("apache", "apache", r"this product includes software developed (?:by|at) the apache software foundation"),
    # GNU
    ("gpl", "program", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "gnu", r"(?:\S+ ){1,4}is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl", "library", r"under the terms of the gnu library general public licen[sc]e"),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", "gnu", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: licen[sc]e)?"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?: licen[sc]e)?"),
    ("agpl", "agpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl(?: licen[sc]e)?"),
    ("gpl", "foundation", r"as published by the free software foundation either version [123](?: \d)? of the licen[sc]e or at your option any later version"),
    ("gpl", "foundation", r"as published by the free software foundation version [123](?: \d)? of the licen[sc]e"),
    ("gpl", "either", r"either version [123](?: \d)? of the licen[sc]e or at your option any later version"),
    ("gpl", "received", r"you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public licen[sc]e along with this program"),
    ("gpl", "gnu", r"see the gnu general public licen[sc]e for more details"),
    ("lgpl", "gnu", r"see the gnu (?:lesser|library) general public licen[sc]e for more details"),
    ("agpl", "gnu", r"see the gnu affero general public licen[sc]e for more details"),
    ("gpl-exception", "exception", r"as a special exception (?:\S+ ){1,12}gives? (?:you )?(?:unlimited )?permission to (?:copy|link)"),
    ("gpl-classpath", "linking", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gfdl", "invariant", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license (?:\S+ ){1,30}invariant sections"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    # Weak copyleft
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl", "mozilla", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[sc]e"),
    ("npl", "netscape", r"the contents of this file are subject to the netscape public licen[sc]e"),
    ("epl", "eclipse", r"(?:this program and )?the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl", "eclipse", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[sc]e"),
    ("cpl", "common", r"the accompanying materials are made available under the terms of the common public licen[sc]e"),
    ("cddl", "development", r"the contents of this file are subject to the terms of (?:either )?the common development and distribution licen[sc]e"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("eupl", "union", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?european union public licen[sc]e"),
    ("artistic", "artistic", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?artistic licen[sc]e"),
    ("perl", "perl", r"(?:you can redistribute it and or modify it )?under the same terms as perl itself"),
    ("cecill", "cecill", r"governed by the cecill(?: [bc])? licen[sc]e under french law"),
    ("osl", "open", r"licensed under the open software licen[sc]e"),
    ("afl", "academic", r"licensed under the academic free licen[sc]e"),
    # Other permissive grants
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("boost", "boost", r"distributed under the boost software licen[sc]e(?: version 1 0)?"),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("ofl", "font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "font", r"the font software may be sold as part of a larger software package"),
    ("python", "psf", r"psf is making python available to licensee"),
    ("python", "psf", r"psf hereby grants licensee a nonexclusive royalty free world ?wide licen[sc]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "young", r"this product includes cryptographic software written by eric young"),
    ("php", "php", r"this product includes php software freely available from"),
    ("php", "php", r"this source file is subject to version \d(?: \d+)? of the php licen[sc]e"),
    ("ncsa", "deal", r"to deal with the software without restriction"),
    ("w3c", "w3c", r"this work (?:\S+ ){1,12}is being provided by the copyright holders under (?:the following|this) w3c licen[sc]e"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    ("unicode", "unicode", r"unicode (?:inc )?licen[sc]e agreement data files and software"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("libpng", "libpng", r"libpng versions? (?:\S+ ){1,20}are copyright"),
    ("freetype", "freetype", r"portions of this software are copyright (?:\S+ ){1,6}the freetype project"),
    ("bzip2", "bzip2", r"this program bzip2 the associated library libbzip2 and all documentation"),
    ("tcl", "tcl", r"tcl tk licen[sc]e terms"),
    ("ruby", "ruby", r"you can redistribute it and or modify it under (?:either )?the (?:terms of the )?ruby licen[sc]e"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("wtfpl", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer(?: in return)?"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    # Public domain
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "waived", r"to the extent possible under law (?:\S+ ){1,12}(?:has |have )?waived all copyright(?: and related or neighboring rights)?"),
    ("public-domain", "domain", r"(?:is |are )?(?:hereby )?(?:released|placed|dedicated|donated)(?: \S+){0,3}? (?:in|to|into) the public domain"),
    ("public-domain", "domain", r"(?:this (?:\S+ ){1,3}is|are) in the public domain"),
    ("public-domain", "government", r"this (?:\S+ ){1,3}is a work of the (?:united states|u s) government"),
    ("pddl", "pddl", r"(?:made available|licensed) under the (?:public domain dedication and licen[sc]e|pddl)(?: v?1 0)? (?:\S+ )?pddl"),
    # Creative Commons and data
    ("cc-by-nc-nd", "noncommercial", r"licensed under (?:a |the )?creative commons attribution noncommercial no ?deriv(?:ative)?s?(?: works)?(?: \S+){0,3}? licen[sc]e"),
    ("cc-by-nc-sa", "noncommercial", r"licensed under (?:a |the )?creative commons attribution noncommercial share ?alike(?: \S+){0,3}? licen[sc]e"),
    ("cc-by-nc", "noncommercial", r"licensed under (?:a |the )?creative commons attribution noncommercial(?: \d \d)?(?: international| unported| generic)? licen[sc]e"),
    ("cc-by-sa", "commons", r"licensed under (?:a |the )?creative commons attribution share ?alike(?: \S+){0,3}? licen[sc]e"),
    ("cc-by-nd", "commons", r"licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: \S+){0,3}? licen[sc]e"),
    ("cc-by", "commons", r"licensed under (?:a |the )?creative commons attribution(?: \d \d)?(?: international| unported| generic)? licen[sc]e"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d \d"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd \d \d"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("odbl", "database", r"(?:made available|licensed) under the open database licen[sc]e"),
    ("odc-by", "commons", r"(?:made available|licensed) under the open data commons attribution licen[sc]e"),
    # Source available, commercial, closed
    ("busl", "production", r"(?:the licensor hereby grants you the right to copy modify create derivative works redistribute and )?make non production use of the licensed work"),
    ("sspl", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", r"the software is provided to you (?:\S+ ){1,12}subject to the commons clause"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial) licen[sc]e(?: \d \d \d)?"),
    ("openrail", "openrail", r"(?:licensed|released|distributed|available) under (?:the )?(?:\S+ )?openrail(?: m| \S+ m)?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama \d(?: \d)? (?:is licensed under the llama \d(?: \d)? )?community licen[sc]e(?: agreement)?"),
    ("proprietary", "confidential", r"(?:this (?:software|document|file|code) is|strictly) confidential and proprietary"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)(?: \S+){0,6}? is (?:strictly )?prohibited"),
    ("proprietary", "trade", r"contains? (?:the )?(?:confidential (?:information )?and )?(?:valuable )?trade secrets of"),
    ("proprietary", "reproduced", r"no part of this (?:\S+ ){1,3}may be reproduced(?: \S+){0,12}? without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("evaluation", "evaluation", r"(?:licensed )?for (?:internal )?evaluation (?:purposes|use) only"),
    ("non-commercial", "commercial", r"(?:free )?for (?:personal and )?non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", r"(?:free )?for (?:personal and )?noncommercial (?:use|purposes) only"),
    ("academic", "research", r"for (?:academic (?:and|or) )?(?:non commercial )?research (?:use|purposes) only"),
    ("academic", "academic", r"for academic(?: and research)? (?:use|purposes) only"),
)

VERSIONS = (
    ("apache", "apache", rf"(?:the )?apache(?: software)? licen[sc]e {V}"),
    ("apache", "apache", rf"apache {V}"),
    ("gpl", "general", rf"(?:the )?(?:gnu )?general public licen[sc]e {V}"),
    ("gpl", "gpl", rf"(?:gnu )?gpl {V}"),
    ("gpl", "gplv2", r"gplv2(?: only| or later)?"),
    ("gpl", "gplv3", r"gplv3(?: only| or later)?"),
    ("lgpl", "lesser", rf"(?:the )?(?:gnu )?lesser general public licen[sc]e {V}"),
    ("lgpl", "library", rf"(?:the )?(?:gnu )?library general public licen[sc]e {V}"),
    ("lgpl", "lgpl", rf"(?:gnu )?lgpl {V}"),
    ("lgpl", "lgplv2", r"lgplv2(?: 1)?(?: only| or later)?"),
    ("lgpl", "lgplv3", r"lgplv3(?: only| or later)?"),
    ("agpl", "affero", rf"(?:the )?(?:gnu )?affero general public licen[sc]e {V}"),
    ("agpl", "agpl", rf"(?:gnu )?agpl {V}"),
    ("agpl", "agplv3", r"agplv3(?: only| or later)?"),
    ("gfdl", "documentation", rf"(?:the )?(?:gnu )?free documentation licen[sc]e {V}"),
    ("gfdl", "gfdl", rf"(?:gnu )?gfdl {V}"),
    ("mpl", "mozilla", rf"(?:the )?mozilla public licen[sc]e {V}"),
    ("mpl", "mpl", rf"mpl {V}"),
    ("epl", "eclipse", rf"(?:the )?eclipse public licen[sc]e {V}"),
    ("epl", "epl", rf"epl {V}"),
    ("edl", "eclipse", rf"(?:the )?eclipse distribution licen[sc]e {V}"),
    ("cddl", "development", rf"(?:the )?common development and distribution licen[sc]e {V}"),
    ("cddl", "cddl", rf"cddl {V}"),
    ("eupl", "union", rf"(?:the )?european union public licen[sc]e {V}"),
    ("eupl", "eupl", rf"eupl {V}"),
    ("artistic", "artistic", rf"(?:the )?artistic licen[sc]e {V}"),
    ("boost", "boost", rf"(?:the )?boost software licen[sc]e {V}"),
    ("boost", "bsl", rf"bsl {V}"),
    ("busl", "business", rf"(?:the )?business source licen[sc]e {V}"),
    ("cpl", "common", rf"(?:the )?common public licen[sc]e {V}"),
    ("ipl", "ibm", rf"(?:the )?ibm public licen[sc]e {V}"),
    ("osl", "open", rf"(?:the )?open software licen[sc]e {V}"),
    ("osl", "osl", rf"osl {V}"),
    ("afl", "academic", rf"(?:the )?academic free licen[sc]e {V}"),
    ("afl", "afl", rf"afl {V}"),
    ("ofl", "font", rf"(?:the )?(?:sil )?open font licen[sc]e {V}"),
    ("ofl", "ofl", rf"(?:sil )?ofl {V}"),
    ("odbl", "database", rf"(?:the )?open database licen[sc]e {V}"),
    ("odbl", "odbl", rf"odbl {V}"),
    ("zpl", "zope", rf"(?:the )?zope public licen[sc]e {V}"),
    ("zpl", "zpl", rf"zpl {V}"),
    ("lppl", "latex", rf"(?:the )?latex project public licen[sc]e {V}"),
    ("lppl", "lppl", rf"lppl {V}"),
    ("php", "php", rf"(?:the )?php licen[sc]e {V}"),
    ("cecill", "cecill", rf"cecill(?: free software)?(?: licen[sc]e)?(?: agreement)? {V}"),
    ("mulan", "mulan", rf"mulan (?:permissive software licen[sc]e|psl) {V}"),
    ("wtfpl", "wtfpl", rf"wtfpl {V}"),
    ("python", "python", rf"(?:the )?python software foundation licen[sc]e {V}"),
    ("upl", "universal", rf"(?:the )?universal permissive licen[sc]e {V}"),
    ("elastic", "elastic", rf"(?:the )?elastic licen[sc]e {V}"),
    ("sspl", "server", rf"(?:the )?server side public licen[sc]e {V}"),
    ("bsd-2-clause", "clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "clause", r"(?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "cc", rf"cc by nc nd {V}(?: deed| legalcode)?"),
    ("cc-by-nc-sa", "cc", rf"cc by nc sa {V}(?: deed| legalcode)?"),
    ("cc-by-nc", "cc", rf"cc by nc {V}(?: deed| legalcode)?"),
    ("cc-by-nd", "cc", rf"cc by nd {V}(?: deed| legalcode)?"),
    ("cc-by-sa", "cc", rf"cc by sa {V}(?: deed| legalcode)?"),
    ("cc-by", "cc", rf"cc by {V}(?: deed| legalcode)?"),
    ("cc-by-nc-nd", "commons", rf"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: international)? {V}(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "commons", rf"creative commons attribution non ?commercial share ?alike(?: international)? {V}(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-nc", "commons", rf"creative commons attribution non ?commercial(?: international)? {V}(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-nd", "commons", rf"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: international)? {V}(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-sa", "commons", rf"creative commons attribution share ?alike(?: international)? {V}(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by", "commons", rf"creative commons attribution(?: international)? {V}(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc0", "cc0", r"cc0 1 0(?: universal)?"),
)

NAMES = (
    ("mit", "mit", r"(?:the )?mit licen[sc]e[ds]?"),
    ("mit", "expat", r"(?:mit )?expat licen[sc]e"),
    ("isc", "isc", r"(?:the )?isc licen[sc]e"),
    ("bsd", "bsd", r"(?:the )?(?:new |modified |simplified |revised |original )?bsd licen[sc]e[ds]?"),
    ("apache", "apache", r"(?:the )?apache(?: software)? licen[sc]e"),
    ("apache", "apache", r"apache licensed"),
    ("gpl", "general", r"(?:the )?(?:gnu )?general public licen[sc]e"),
    ("gpl", "gnu", r"gnu gpl"),
    ("lgpl", "lesser", r"(?:the )?(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library", r"(?:the )?(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "gnu", r"gnu lgpl"),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "gnu", r"gnu agpl"),
    ("gfdl", "documentation", r"(?:the )?(?:gnu )?free documentation licen[sc]e"),
    ("gnu-all-permissive", "permissive", r"gnu all permissive licen[sc]e"),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[sc]e"),
    ("npl", "netscape", r"(?:the )?netscape public licen[sc]e"),
    ("epl", "eclipse", r"(?:the )?eclipse public licen[sc]e"),
    ("edl", "eclipse", r"(?:the )?eclipse distribution licen[sc]e"),
    ("cddl", "development", r"(?:the )?common development and distribution licen[sc]e"),
    ("cpl", "common", r"(?:the )?common public licen[sc]e"),
    ("ipl", "ibm", r"(?:the )?ibm public licen[sc]e"),
    ("eupl", "union", r"(?:the )?european union public licen[sc]e"),
    ("artistic", "artistic", r"(?:the )?artistic licen[sc]e"),
    ("boost", "boost", r"(?:the )?boost software licen[sc]e"),
    ("busl", "business", r"(?:the )?business source licen[sc]e"),
    ("osl", "open", r"(?:the )?open software licen[sc]e"),
    ("afl", "academic", r"(?:the )?academic free licen[sc]e"),
    ("ofl", "font", r"(?:the )?(?:sil )?open font licen[sc]e"),
    ("odbl", "database", r"(?:the )?open database licen[sc]e"),
    ("zpl", "zope", r"(?:the )?zope public licen[sc]e"),
    ("lppl", "latex", r"(?:the )?latex project public licen[sc]e"),
    ("php", "php", r"(?:the )?php licen[sc]e"),
    ("python", "python", r"(?:the )?python software foundation licen[sc]e"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[sc]e"),
    ("mulan", "mulan", r"mulan (?:permissive software licen[sc]e|psl)"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "want", r"do what the (?:\S+ )?you want to public licen[sc]e"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal licen[sc]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("openssl", "openssl", r"(?:the )?openssl licen[sc]e"),
    ("x11", "x11", r"(?:the )?x11 licen[sc]e"),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[sc]e"),
    ("upl", "universal", r"(?:the )?universal permissive licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("beerware", "beerware", r"beerware(?: licen[sc]e)?"),
    ("cc0", "cc0", r"cc0"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: licen[sc]e)?"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: licen[sc]e)?"),
    ("cc-by", "commons", r"creative commons attribution(?: licen[sc]e)?"),
    ("cc", "commons", r"(?:a )?creative commons licen[sc]e"),
    ("elastic", "elastic", r"(?:the )?elastic licen[sc]e"),
    ("sspl", "server", r"(?:the )?server side public licen[sc]e"),
    ("commons-clause", "clause", r"commons clause"),
    ("openrail", "openrail", r"openrail(?: m)?"),
    ("gpl", "copyleft", r"copyleft(?: licen[sc]e)?"),
)

GENERAL = (
    ("reserved", "reserved", r"all rights reserved"),
    ("reserved", "reserved", r"(?:some|no) rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:present|(?:19|20)\d\d))?(?: by)?"),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|software)"),
    ("warranty", "warranty", r"without (?:any )?warranty of any kind"),
    ("warranty", "warranty", r"without even the implied warranty of merchantability"),
    ("warranty", "warranties", r"without warranties or conditions of any kind"),
    ("warranty", "warranties", r"(?:any )?(?:express or implied|implied) warranties including but not limited to"),
    ("warranty", "merchantability", r"warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("liability", "liable", r"in no event shall (?:\S+ ){1,20}be liable for any"),
    ("eula", "agreement", r"end user licen[sc]e agreement"),
    ("eula", "eula", r"eula"),
    ("agreement", "agreement", r"(?:software )?licen[sc]e agreement"),
    ("terms", "governed", r"governed by (?:the )?(?:terms|laws) of"),
    ("trademark", "trademark", r"(?:registered )?trademark of"),
    ("trademark", "trademarks", r"(?:registered )?trademarks of"),
    ("patent", "pending", r"(?:u s )?patents? pending"),
    ("see-license", "license", r"see (?:the )?(?:accompanying )?license (?:file |txt )?for (?:more )?(?:details|information|terms)"),
    ("see-license", "licensing", r"licensing information"),
)


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, gate, pattern) in order of priority."""
    tiers = ((TAG, TAGS), (GRANT, GRANTS), (VERSIONED, VERSIONS), (NAMED, NAMES), (GENERIC, GENERAL))
    return [(tier, *rule) for tier, some in tiers for rule in some]
