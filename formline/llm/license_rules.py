"""The signature rules of the licence scan: what is written here is read in order, earlier rules have priority.

Patterns see words only: ASCII letters in lower case, digits and non-ASCII characters, single spaces
between words, so ``GPL-3.0`` reads ``gpl 3 0``.  ``forms`` sets every licence's names into the ways
in which texts state a licence; statements that have one wording only are signatures of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Phrases that every scan counts, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: No pattern below spans more words.
LONGEST = 96

# Wordings of whole licences and notices: label, words that must all be in the text, pattern.
SIGNATURES = r"""
mit | granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software (?:\S+ ){0,30}without restriction (?:\S+ ){0,12}to permit persons to whom the software is furnished to do so the software is provided
x11 | advertising consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse contributors | neither the names? of (?:\S+ ){1,16}nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-2-clause | redistributions binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | redistribution modification | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
0bsd | fee granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | fee granted | permission to use copy modify (?:and|and or|or) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
apache-2 | compliance license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | asf contributor | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1 | apache acknowledgment | this product includes software developed by the apache (?:group|software foundation)
gpl-3-or-later | option general | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-or-later | option general | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-1-or-later | option general | gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-3 | foundation general | gnu general public license as published by the free software foundation version 3 of the license
gpl-2 | foundation general | gnu general public license as published by the free software foundation version 2 of the license
lgpl-3-or-later | lesser option | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | lesser option | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2-or-later | library option | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3-or-later | affero option | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
fdl-1.3-or-later | documentation invariant | gnu free documentation license version 1 3 or any later version published by the free software foundation
fdl-1.2-or-later | documentation invariant | gnu free documentation license version 1 2 or any later version published by the free software foundation
gpl-exception-classpath | linking independent | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-exception-gcc | runtime exception | gcc runtime library exception
gpl-exception-autoconf | configure exception | configuration script generated by autoconf you may include it under the same distribution terms
mpl-2 | mozilla source | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public license version 1 1
epl-2 | eclipse accompanying | made available under the terms of the eclipse public license 2 0
epl-1 | eclipse accompanying | made available under the terms of the eclipse public license v1 0
cddl-1 | cddl contents | the contents of this file are subject to the terms of the common development and distribution license
zlib | misrepresented altered | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | png altered | the origin of this source code must not be misrepresented
boost-1 | boost granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | fuck want | do what the fuck you want to public license
beerware | beer revision | the beer ware license revision 42
cc0 | waived neighboring | has waived all copyright and related or neighboring rights
cc0 | extent possible | to the extent possible under law (?:\S+ ){1,8}has waived all copyright
postgresql | postgresql fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ntp | fee supporting | permission to use copy modify and distribute this software and its documentation for any purpose (?:\S+ ){0,4}fee is hereby granted provided that the above copyright notice appears? in all copies
curl | granted fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic eric | this product includes cryptographic software written by eric young
php-3.01 | php freely | this product includes php software freely available from
python-2 | psf python | psf is making python available to licensee on an as is basis
ruby | ruby freeware | you may make and give away verbatim copies of the source form of the software without restriction
artistic-1 | artistic copyright | the intent of this document is to state the conditions under which a package may be copied
artistic-2 | artistic copyright | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ofl-1.1 | font reserved | this font software is licensed under the sil open font license version 1 1
vim | vim licence | there are no restrictions on distributing unmodified copies of vim
tcl-tk | granted rights | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
icu | granted unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
hpnd | suitability documentation | makes no representations about the suitability of this software for any purpose it is provided as is
json | good evil | the software shall be used for good not evil
sspl-1 | server offering | server side public license as published by mongodb
elastic-2 | managed hosted | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | licensor production | use limitation is subject to the change date and the change license
commons-clause | sell clause | does not grant to you the right to sell the software
proprietary | proprietary confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | permission reproduced | no part of this (?:work|publication|document|book|page|site|text) may be reproduced (?:\S+ ){0,24}without (?:the )?(?:prior |express |written )+permission
proprietary | rights reserved | all rights reserved
public-domain | domain public | (?:dedicated to|released (?:in)?to|placed in(?:to)?|is in|are in) the public domain
"""

# Licences by name: label, words of its short identifier, names (patterns), "alone" where the name is a statement by itself
# and "said" where it is one only in a form, words of its address (or -).
NAMES = r"""
mit-0 | mit 0 | mit no attribution(?: license)? | alone | opensource org licenses mit 0
mit | mit | (?:mit|expat) licen[cs]e | alone | opensource org licenses? mit(?: license)?
x11 | x11 | (?:x11|mit x11|x consortium) licen[cs]e | alone | -
isc | isc | isc licen[cs]e | alone | opensource org licenses? isc(?: license)?
0bsd | 0bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)? | alone | opensource org licenses 0bsd
bsd-4-clause | bsd 4 clause | (?:original|4 clause|four clause) bsd(?: licen[cs]e)? | alone | spdx org licenses bsd 4 clause
bsd-3-clause-clear | bsd 3 clause clear | clear bsd licen[cs]e | alone | spdx org licenses bsd 3 clause clear
bsd-3-clause | bsd 3 clause | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)? | alone | opensource org licenses bsd 3 clause
bsd-2-clause-patent | bsd 2 clause patent | bsd 2 clause plus patent(?: licen[cs]e)? | alone | opensource org licenses bsdpluspatent
bsd-2-clause | bsd 2 clause | (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)? | alone | opensource org licenses bsd 2 clause
bsd | bsd | (?:a |the )?bsd(?: style)? licen[cs]e | alone | opensource org licenses bsd license
apache-2 | apache 2 0 | apache (?:software )?licen[cs]e (?:version |v |v)?2(?: 0)? | alone | apache org licenses license 2 0
apache-1.1 | apache 1 1 | apache (?:software )?licen[cs]e (?:version |v |v)?1 1 | alone | apache org licenses license 1 1
apache-1 | apache 1 0 | apache (?:software )?licen[cs]e (?:version |v |v)?1 0 | alone | apache org licenses license 1 0
apache | apache | apache (?:software )?licen[cs]e | alone | apache org licenses
agpl-3-or-later | agpl 3 0 or later | (?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version)? v?3(?: 0)? or (?:any )?later(?: version)? | alone | -
agpl-3 | agpl 3 0(?: only)? | (?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version)? v?3(?: 0)? | alone | gnu org licenses agpl 3 0
agpl | agpl | (?:gnu )?affero general public licen[cs]e | alone | gnu org licenses agpl
lgpl-3-or-later | lgpl 3 0 or later | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version)? v?3(?: 0)? or (?:any )?later(?: version)? | alone | -
lgpl-3 | lgpl 3 0(?: only)? | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version)? v?3(?: 0)? | alone | gnu org licenses lgpl 3 0
lgpl-2.1-or-later | lgpl 2 1 or later | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version)? v?2 1 or (?:any )?later(?: version)? | alone | -
lgpl-2.1 | lgpl 2 1(?: only)? | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version)? v?2 1 | alone | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2 | lgpl 2 0(?: only)? | (?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version)? v?2(?: 0)? | alone | gnu org licenses old licenses lgpl 2 0
lgpl | lgpl | (?:gnu )?(?:lesser|library) general public licen[cs]e | alone | gnu org licenses lgpl
gpl-3-or-later | gpl 3 0 or later | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version)? v?3(?: 0)? or (?:any )?later(?: version)? | alone | -
gpl-3 | gpl 3 0(?: only)? | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version)? v?3(?: 0)? | alone | gnu org licenses gpl 3 0
gpl-2-or-later | gpl 2 0 or later | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version)? v?2(?: 0)? or (?:any )?later(?: version)? | alone | -
gpl-2 | gpl 2 0(?: only)? | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version)? v?2(?: 0)? | alone | gnu org licenses (?:old licenses )?gpl 2 0
gpl-1 | gpl 1 0(?: only)? | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version)? v?1(?: 0)? | alone | gnu org licenses old licenses gpl 1 0
gpl | gpl | (?:gnu general public licen[cs]e|gnu gpl) | alone | gnu org licenses gpl
fdl-1.3 | gfdl 1 3(?: only| or later)? | gnu free documentation licen[cs]e(?: version)? v?1 3 | alone | gnu org licenses fdl 1 3
fdl-1.2 | gfdl 1 2(?: only| or later)? | gnu free documentation licen[cs]e(?: version)? v?1 2 | alone | gnu org licenses (?:old licenses )?fdl 1 2
fdl | gfdl | (?:gnu free documentation licen[cs]e|gfdl) | alone | gnu org (?:licenses|copyleft) fdl
mpl-2 | mpl 2 0 | (?:mozilla public licen[cs]e|mpl)(?: version)? v?2(?: 0)? | alone | mozilla org mpl 2 0
mpl-1.1 | mpl 1 1 | (?:mozilla public licen[cs]e|mpl)(?: version)? v?1 1 | alone | mozilla org mpl 1 1
mpl-1 | mpl 1 0 | (?:mozilla public licen[cs]e|mpl)(?: version)? v?1 0 | alone | mozilla org mpl 1 0
mpl | mpl | mozilla public licen[cs]e | alone | mozilla org mpl
epl-2 | epl 2 0 | (?:eclipse public licen[cs]e|epl)(?: version)? v?2(?: 0)? | alone | eclipse org legal epl 2 0
epl-1 | epl 1 0 | (?:eclipse public licen[cs]e|epl)(?: version)? v?1(?: 0)? | alone | eclipse org legal epl v10
epl | epl | eclipse public licen[cs]e | alone | eclipse org legal epl
edl-1 | bsd 3 clause edl | eclipse distribution licen[cs]e(?: version)? v?1(?: 0)? | alone | eclipse org org documents edl v10
cpl-1 | cpl 1 0 | common public licen[cs]e(?: version)? v?1(?: 0)? | alone | opensource org licenses cpl1 0
cddl-1.1 | cddl 1 1 | (?:common development and distribution licen[cs]e|cddl)(?: version)? v?1 1 | alone | -
cddl-1 | cddl 1 0 | (?:common development and distribution licen[cs]e|cddl)(?: version)? v?1(?: 0)? | alone | opensource org licenses cddl 1 0
eupl-1.2 | eupl 1 2 | european union public licen[cs]e(?: version)? v?1 2 | alone | joinup ec europa eu collection eupl
eupl-1.1 | eupl 1 1 | european union public licen[cs]e(?: version)? v?1 1 | alone | -
eupl | eupl | european union public licen[cs]e | alone | -
cecill-2.1 | cecill 2 1 | cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)? v?2 1 | alone | cecill info licences licence cecill v2 1
cecill-b | cecill b | cecill b(?: licen[cs]e)? | said | cecill info licences licence cecill b
cecill-c | cecill c | cecill c(?: licen[cs]e)? | said | cecill info licences licence cecill c
zlib | zlib | zlib(?: libpng)? licen[cs]e | alone | opensource org licenses zlib
libpng | libpng(?: 2 0)? | (?:libpng|png reference library) licen[cs]e | alone | libpng org pub png src libpng license
boost-1 | bsl 1 0 | boost software licen[cs]e(?: version)?(?: v?1 0)? | alone | boost org license 1 0
unlicense | unlicense | (?:the )?unlicense | said | unlicense org
wtfpl | wtfpl | wtfpl(?: version 2| 2)? | said | wtfpl net
beerware | beerware | (?:beer ware|beerware) licen[cs]e | alone | -
postgresql | postgresql | postgresql licen[cs]e | alone | opensource org licenses postgresql
ntp | ntp | ntp licen[cs]e | alone | opensource org licenses ntp
curl | curl | curl licen[cs]e | alone | curl (?:se|haxx se) docs copyright
openssl | openssl | openssl licen[cs]e | alone | openssl org source license
php-3.01 | php 3 01 | php licen[cs]e(?: version)?(?: v?3 01)? | alone | php net license
python-2 | psf 2 0 | python (?:software foundation )?licen[cs]e(?: version)?(?: v?2(?: 0)?)? | alone | docs python org 3 license
ruby | ruby | ruby licen[cs]e | alone | ruby lang org en about license
artistic-2 | artistic 2 0 | artistic licen[cs]e(?: version)? v?2(?: 0)? | alone | opensource org licenses artistic 2 0
artistic-1 | artistic 1 0(?: perl| cl8)? | artistic licen[cs]e(?: version)? v?1(?: 0)? | alone | opensource org licenses artistic 1 0
artistic | artistic | artistic licen[cs]e | alone | -
ofl-1.1 | ofl 1 1(?: rfn| no rfn)? | sil open font licen[cs]e(?: version)?(?: v?1 1)? | alone | scripts sil org ofl
vim | vim | vim licen[cs]e | alone | vimdoc sourceforge net htmldoc uganda
tcl-tk | tcl | tcl tk licen[cs]e | alone | tcl tk software tcltk license
icu | icu | icu licen[cs]e | alone | -
unicode-3 | unicode 3 0 | unicode licen[cs]e v3 | alone | unicode org license
hpnd | hpnd | historical permission notice and disclaimer | alone | opensource org licenses hpnd
json | json | json licen[cs]e | alone | json org license
afl-3 | afl 3 0 | academic free licen[cs]e(?: version)? v?3(?: 0)? | alone | opensource org licenses afl 3 0
osl-3 | osl 3 0 | open software licen[cs]e(?: version)? v?3(?: 0)? | alone | opensource org licenses osl 3 0
ms-pl | ms pl | microsoft public licen[cs]e | alone | opensource org licenses ms pl
ms-rl | ms rl | microsoft reciprocal licen[cs]e | alone | opensource org licenses ms rl
ncsa | ncsa | (?:university of illinois ncsa|uiuc ncsa|ncsa) open source licen[cs]e | alone | opensource org licenses (?:ncsa|uoi ncsa)
w3c | w3c | w3c software (?:notice and )?licen[cs]e | alone | w3 org consortium legal
upl-1 | upl 1 0 | universal permissive licen[cs]e(?: version)?(?: v?1 0)? | alone | opensource org licenses upl
mulan-2 | mulanpsl 2 0 | mulan permissive software licen[cs]e(?: version)?(?: v?2)? | alone | license coscl org cn mulanpsl2
blueoak-1 | blueoak 1 0 0 | blue oak model licen[cs]e(?: 1 0 0)? | alone | blueoakcouncil org license 1 0 0
sspl-1 | sspl 1 0 | server side public licen[cs]e(?: version)?(?: v?1)? | alone | mongodb com licensing server side public license
elastic-2 | elastic 2 0 | elastic licen[cs]e(?: version)? v?2(?: 0)? | alone | elastic co licensing elastic license
busl-1.1 | busl 1 1 | business source licen[cs]e(?: version)?(?: v?1 1)? | alone | mariadb com bsl11
polyform-nc-1 | polyform noncommercial 1 0 0 | polyform noncommercial licen[cs]e(?: 1 0 0)? | alone | polyformproject org licenses noncommercial
polyform-sb-1 | polyform small business 1 0 0 | polyform small business licen[cs]e(?: 1 0 0)? | alone | polyformproject org licenses small business
openrail-m | openrail m | (?:bigscience |creativeml )?(?:open rail m|openrail m?) ?licen[cs]e | alone | -
odbl-1 | odbl 1 0 | (?:open database licen[cs]e|odbl)(?: version)?(?: v?1 0)? | said | opendatacommons org licenses odbl
odc-by-1 | odc by 1 0 | (?:open data commons attribution licen[cs]e|odc by)(?: version)?(?: v?1 0)? | said | opendatacommons org licenses by
pddl-1 | pddl 1 0 | (?:open data commons )?public domain dedication and licen[cs]e | alone | opendatacommons org licenses pddl
ogl-uk-3 | ogl uk 3 0 | open government licen[cs]e(?: for public sector information)?(?: version)? v?3(?: 0)? | alone | nationalarchives gov uk doc open government licence version 3
ogl-uk | ogl uk 1 0 | open government licen[cs]e | alone | nationalarchives gov uk doc open government licence
etalab-2 | etalab 2 0 | (?:licence ouverte|etalab open licence)(?: version)?(?: v?2(?: 0)?)? | alone | etalab gouv fr licence ouverte
dl-de-by-2 | dl de by 2 0 | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)? | alone | govdata de dl de by 2 0
"""

# Public licences of one family: parts of the name, in the order in which a longer one comes first.
CC_PARTS = (
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
)
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried on texts that hold all words of ``every`` and, where ``some`` has words, one of them; ``weight``: how sure a match is."""

    label: str
    every: frozenset[bytes]
    some: frozenset[bytes]
    pattern: re.Pattern[bytes]
    weight: float


_GRANT = (
    r"(?:licen[cs]ed|sub ?licen[cs]ed|released|distributed|available|published|provided|issued|offered|redistributed|shared|covered|governed|licen[cs]e|use)"
    r"(?: to you)? under(?: the| a| an)?(?: terms(?: and conditions)? of(?: the| a| an)?| conditions of(?: the)?)? "
)


#: Words of names that say nothing about which licence is meant.
_PLAIN = frozenset("version the and any later software public open free source only style clause original new modified revised simplified clear zero two three four for not terms conditions".split())


def _rule(label: str, every: str, pattern: str, weight: float, some: str = "") -> Rule:
    words = (frozenset(w.encode().split()) for w in (every, some))
    return Rule(label, *words, re.compile(b" (?:" + pattern.encode() + b")(?= )"), weight)


def telling(pattern: str) -> str:
    """The words of a name's pattern that are not plain ones, or all where all are: whatever it matches holds one of them."""
    words = {w for w in re.findall(r"[a-z][a-z0-9]+", re.sub(r"licen\[cs\]e", " ", pattern)) if len(w) > 2}
    return " ".join(sorted(words - _PLAIN or words))


def _signatures() -> list[Rule]:
    return [_rule(*(c.strip() for c in line.split(" | ", 2)), 1.0) for line in SIGNATURES.strip().splitlines()]


def forms() -> list[Rule]:
    """Of every named licence: its identifier, a grant, its address and, where it stands for itself, its name."""
    spdx, grants, urls, alone = [], [], [], []
    for line in NAMES.strip().splitlines():
        label, short, name, how, url = (c.strip() for c in line.split(" | "))
        spdx.append(_rule(label, "spdx", f"spdx licen[cs]e identifier {short}", 1.0))
        grants.append(_rule(label, "under", f"{_GRANT}(?:{name})", 0.95, telling(name)))
        if url != "-":
            sure = re.findall(r"[a-z0-9]{3,}", re.sub(r"\([^()]*\)\??", " ", url))
            urls.append(_rule(label, max(sure, key=len), url, 0.9))
        if how == "alone":
            alone.append(_rule(label, "", name, 0.8, telling(name)))
    return spdx + grants + urls + alone


def creative_commons() -> list[Rule]:
    """The public licences of one family, with a version and without."""
    out = []
    for version in (*CC_VERSIONS, ""):
        for label, short, long in CC_PARTS:
            tail = " " + version.replace(".", " ") if version else ""
            named = f"{label}-{version}" if version else label
            out.append(_rule(named, "spdx cc", f"spdx licen[cs]e identifier cc {short}{tail}", 1.0))
            out.append(_rule(named, "creativecommons org", f"creativecommons org licenses {short}{tail}", 0.95))
            out.append(_rule(named, "creative commons", f"creative commons {long}(?: (?:international|unported|generic|public))*{tail}", 0.95))
            if version or " " in short:  # "cc by" alone may be anything
                out.append(_rule(named, "cc", f"cc {short}{tail}", 0.9))
    out += [
        _rule("cc0", "spdx cc0", "spdx licen[cs]e identifier cc0(?: 1 0)?", 1.0), _rule("cc0", "creativecommons org", "creativecommons org publicdomain zero(?: 1 0)?", 0.95),
        _rule("cc0", "creative commons", "creative commons (?:cc0|zero)(?: 1 0)?", 0.95), _rule("cc0", "cc0", "cc0(?: 1 0)?", 0.9),
        _rule("cc-pdm", "creativecommons org", "creativecommons org publicdomain mark 1 0", 0.95), _rule("cc-unknown", "creative commons", "creative commons licen[cs]e", 0.6),
    ]
    return out


#: All rules, the surest kind of statement first.
RULES: tuple[Rule, ...] = (*_signatures(), *creative_commons(), *forms())
