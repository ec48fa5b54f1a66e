"""Signature rules of licences, in classes of priority, the first class before all others.

A rule is `label | keyword | pattern` over words in lower case that one space parts: letters without A-Z, digits and all that isn't ASCII. A pattern must
match whole words. It is only tried on texts that hold the keyword. Patterns keep to what Spark's and DuckDB's expressions agree on:
no look-around, no back-references, every repetition bounded by words.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


#: A version in words, with or without a word before it: {v} of a rule.
VERSION = r"(?:version |ver |v )?v?"

#: Class 1: identifiers made for machines.
IDENTIFIERS = """
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
bsl-1.0 | spdx | spdx license identifier bsl 1 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0-1.0 | spdx | spdx license identifier cc0 1 0
artistic-2.0 | spdx | spdx license identifier artistic 2 0
postgresql | spdx | spdx license identifier postgresql
ofl-1.1 | spdx | spdx license identifier ofl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1.0 | spdx | spdx license identifier sspl 1 0
ncsa | spdx | spdx license identifier ncsa
x11 | spdx | spdx license identifier x11
python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
"""

#: Class 2: sentences of the texts themselves, and notices that name licence and version.
SENTENCES = """
mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit | licen | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit (?:style )?licen[cs]e
mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)?
mit-modern | permission is hereby | permission is hereby granted without written agreement and without license or royalty fees
x11 | mit x11 | mit x11 licen[cs]e
x11 | x consortium | except as contained in this notice the name of the x consortium
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e
bsd-2-clause | bsd | bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause | neither the name | neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|the|his|their) contributors may be used to endorse or promote
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3-clause-clear | bsd | (?:clear bsd|bsd 3 clause clear)(?: licen[cs]e)?
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd licen[cs]e
bsd-4-clause | bsd | bsd (?:4|four) clause(?: licen[cs]e)?
bsd-1-clause | bsd | bsd (?:1|one) clause(?: licen[cs]e)?
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd-protection | bsd | bsd protection licen[cs]e
apache-2.0 | apache | licensed under the apache licen[cs]e {v}2(?: 0)?
apache-2.0 | apache | you may not use this file except in compliance with the license (?:[^ ]+ ){0,12}apache org licenses license 2 0
apache-2.0 | apache | apache software licen[cs]e {v}2(?: 0)?
apache-2.0 | apache | apache org licenses license 2 0
apache-1.1 | apache | apache software licen[cs]e {v}1 1
apache-1.1 | apache | this product includes software developed by the apache (?:software foundation|group)
apache-1.0 | apache | apache software licen[cs]e {v}1 0
gpl-3.0 | gnu general public | licensed under (?:the )?(?:terms of the )?gnu general public licen[cs]e {v}3(?: 0)?
gpl-2.0 | gnu general public | licensed under (?:the )?(?:terms of the )?gnu general public licen[cs]e {v}2(?: 0)?
gpl-3.0-or-later | gnu general public | gnu general public license as published by the free software foundation either version 3(?: 0)? of the license or (?:at your option )?any later version
gpl-2.0-or-later | gnu general public | gnu general public license as published by the free software foundation either version 2(?: 0)? of the license or (?:at your option )?any later version
gpl-1.0-or-later | gnu general public | gnu general public license as published by the free software foundation either version 1(?: 0)? of the license or (?:at your option )?any later version
lgpl-3.0-or-later | gnu lesser general | gnu lesser general public license as published by the free software foundation either version 3(?: 0)? of the license or (?:at your option )?any later version
lgpl-2.1-or-later | gnu lesser general | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-2.0-or-later | gnu library general | gnu library general public license as published by the free software foundation either version 2(?: 0)? of the license or (?:at your option )?any later version
agpl-3.0-or-later | gnu affero general | gnu affero general public license as published by the free software foundation either version 3(?: 0)? of the license or (?:at your option )?any later version
gpl-classpath-exception | special exception | as a special exception the copyright holders of this library give you permission to link
gpl-gcc-exception | gcc runtime | gcc runtime library exception(?: {v}3 1)?
gpl-font-exception | font exception | (?:gpl )?font exception
mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla public | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | netscape public | the contents of this file are subject to the netscape public license version 1 1
npl-1.0 | netscape public | the contents of this file are subject to the netscape public license version 1 0
epl-2.0 | eclipse public | terms of the eclipse public license {v}2(?: 0)?
epl-1.0 | eclipse public | terms of the eclipse public license {v}1(?: 0)?
cddl-1.0 | common development and | the contents of this file are subject to the terms of the common development and distribution license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | what the | do what the f[^ ]+ you want to(?: public licen[cs]e)?
cc0-1.0 | to the extent possible | to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | in no event will | in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0 | boost | distributed under the boost software license version 1 0
bsl-1.0 | machine executable | solely in the form of machine executable object code generated by a source language processor
ofl-1.1 | open font | this font software is licensed under the sil open font license version 1 1
ofl-1.0 | open font | this font software is licensed under the sil open font license version 1 0
lppl-1.3c | latex project | latex project public license either version 1 3c? of this license or
php-3.01 | php | subject to version 3 01 of the php licen[cs]e
php-3.0 | php | subject to version 3 0 of the php licen[cs]e
python-2.0 | python software foundation | python software foundation licen[cs]e {v}2
ncsa | university of illinois | university of illinois (?:at urbana champaign )?(?:ncsa )?open source licen[cs]e
openssl | openssl | this product includes software developed by the openssl project
ssleay | eric young | this product includes cryptographic software written by eric young
json | for good not evil | the software shall be used for good not evil
beerware | buy me a beer | you can buy me a beer in return
postgresql | postgresql | released under the postgresql licen[cs]e
eupl-1.2 | eupl | licensed under the eupl {v}1 2
eupl-1.1 | eupl | licensed under the eupl {v}1 1
ms-pl | microsoft public | licensed under the microsoft public licen[cs]e
ms-rl | microsoft reciprocal | licensed under the microsoft reciprocal licen[cs]e
sspl-1.0 | server side public | server side public licen[cs]e {v}1(?: 0)?
busl-1.1 | business source | business source licen[cs]e {v}1 1
elastic-2.0 | elastic | elastic licen[cs]e {v}2(?: 0)?
commons-clause | commons clause | commons clause licen[cs]e condition {v}1 0
all-rights-reserved | all rights reserved | copyright (?:c )?(?:[^ ]+ ){1,8}all rights reserved
proprietary | confidential | this (?:software|document|file) is (?:the )?(?:confidential and proprietary|proprietary and confidential)
proprietary | unauthori | unauthori[sz]ed copying of this (?:file|software|document) (?:via any medium )?is strictly prohibited
no-commercial-use | commercial use | (?:not for|no|without) commercial use
no-commercial-use | noncommercial | for noncommercial (?:use|purposes) only
no-derivatives | derivative | no derivative works (?:are )?(?:allowed|permitted)
public-domain | public domain | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
mit | lizenz | (?:unter der|unter) mit lizenz
apache-2.0 | lizenz | (?:unter der|unter) apache lizenz {v}2(?: 0)?
gpl | gnu general public | (?:unter der|unter) gnu general public licen[sc]e
mit | licence | sous (?:la )?licence mit
gpl | licence | sous (?:la )?licence (?:publique générale gnu|gnu gpl)
mit | licencia | bajo (?:la )?licencia mit
apache-2.0 | licencia | bajo (?:la )?licencia apache {v}2(?: 0)?
gpl | licencia | bajo (?:la )?licencia (?:pública general(?: de)? gnu|gnu gpl)
"""

#: Class 3: names with a version or a variant.
NAMES = """
apache-2.0 | apache | apache licen[cs]e {v}2(?: 0)?
apache-2.0 | apache | apache {v}2 0(?: licen[cs]e)?
apache-1.1 | apache | apache licen[cs]e {v}1 1
apache-1.0 | apache | apache licen[cs]e {v}1 0
mit | licen | mit licen[cs]e
mit | licen | (?:the )?expat licen[cs]e
x11 | licen | x11 licen[cs]e
isc | licen | isc licen[cs]e
zlib | zlib | zlib (?:libpng )?licen[cs]e
libpng | libpng | libpng licen[cs]e(?: {v}2)?
bsl-1.0 | boost | boost software licen[cs]e(?: {v}1 0)?
mpl-2.0 | mozilla public | mozilla public licen[cs]e {v}2(?: 0)?
mpl-1.1 | mozilla public | mozilla public licen[cs]e {v}1 1
mpl-1.0 | mozilla public | mozilla public licen[cs]e {v}1 0
mpl-2.0 | mpl | mpl {v}2(?: 0)?
mpl-1.1 | mpl | mpl {v}1 1
epl-2.0 | eclipse public | eclipse public licen[cs]e {v}2(?: 0)?
epl-1.0 | eclipse public | eclipse public licen[cs]e {v}1(?: 0)?
epl-2.0 | epl | epl {v}2 0
epl-1.0 | epl | epl {v}1 0
edl-1.0 | eclipse distribution | eclipse distribution licen[cs]e(?: {v}1 0)?
cddl-1.1 | common development and | common development and distribution licen[cs]e {v}1 1
cddl-1.0 | common development and | common development and distribution licen[cs]e(?: {v}1 0)?
cddl-1.0 | cddl | cddl {v}1 0
cpl-1.0 | common public | common public licen[cs]e(?: {v}1 0)?
ipl-1.0 | ibm public | ibm public licen[cs]e(?: {v}1 0)?
cpal-1.0 | common public attribution | common public attribution licen[cs]e(?: {v}1 0)?
artistic-2.0 | artistic | artistic licen[cs]e {v}2(?: 0)?
artistic-1.0 | artistic | artistic licen[cs]e {v}1(?: 0)?
artistic-clarified | artistic | clarified artistic licen[cs]e
python-2.0 | python software foundation | python software foundation licen[cs]e
python-2.0 | psf | psf licen[cs]e(?: {v}2)?
php-3.01 | php | php licen[cs]e {v}3 01
php-3.0 | php | php licen[cs]e {v}3 0
ruby | ruby | ruby(?: s)? licen[cs]e
ofl-1.1 | open font | (?:sil )?open font licen[cs]e {v}1 1
ofl-1.0 | open font | (?:sil )?open font licen[cs]e {v}1 0
osl-3.0 | open software | open software licen[cs]e {v}3 0
osl-2.1 | open software | open software licen[cs]e {v}2 1
osl-1.0 | open software | open software licen[cs]e {v}1 0
afl-3.0 | academic free | academic free licen[cs]e {v}3 0
afl-2.1 | academic free | academic free licen[cs]e {v}2 1
afl-1.1 | academic free | academic free licen[cs]e {v}1 1
eupl-1.2 | european union public | european union public licen[cs]e {v}1 2
eupl-1.1 | european union public | european union public licen[cs]e {v}1 1
eupl-1.0 | european union public | european union public licen[cs]e {v}1 0
eupl-1.2 | eupl | eupl {v}1 2
eupl-1.1 | eupl | eupl {v}1 1
cecill-2.1 | cecill | cecill (?:licen[cs]e )?{v}2 1
cecill-2.0 | cecill | cecill (?:licen[cs]e )?{v}2 0
cecill-b | cecill | cecill b(?: licen[cs]e)?
cecill-c | cecill | cecill c(?: licen[cs]e)?
ms-pl | microsoft public | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
ncsa | ncsa | ncsa open source licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
odbl-1.0 | open database | open (?:data commons )?(?:open )?database licen[cs]e(?: {v}1 0)?
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e(?: {v}1 0)?
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e(?: {v}1 0)?
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | creative commons | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
lppl-1.3 | latex project | latex project public licen[cs]e {v}1 3[ac]?
zpl-2.1 | zope public | zope public licen[cs]e {v}2 1
zpl-2.0 | zope public | zope public licen[cs]e {v}2 0
w3c | w3c | w3c (?:software )?(?:notice and )?(?:document )?licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
qpl-1.0 | q public | q public licen[cs]e(?: {v}1 0)?
rpl-1.5 | reciprocal public | reciprocal public licen[cs]e(?: {v}1 5)?
sissl | sun industry | sun industry standards source licen[cs]e
spl-1.0 | sun public | sun public licen[cs]e(?: {v}1 0)?
apsl-2.0 | apple public | apple public source licen[cs]e(?: {v}2 0)?
upl-1.0 | universal permissive | universal permissive licen[cs]e(?: {v}1 0)?
unicode | unicode | unicode (?:data files and software )?licen[cs]e(?: agreement)?
vim | vim | vim licen[cs]e
curl | curl | curl licen[cs]e
blue-oak-1.0.0 | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
mulan-psl-2.0 | mulan | mulan (?:permissive software licen[cs]e|psl) {v}2
hippocratic | hippocratic | hippocratic licen[cs]e
llama-community | llama | llama (?:2 |3 )?community licen[cs]e(?: agreement)?
openrail | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
"""

#: Class 4: names alone.
BARE = """
apache | apache | (?:the )?apache(?: software)? licen[cs]e
bsd | bsd | (?:the )?(?:berkeley )?bsd(?: style)? licen[cs]e
gpl | gnu general public | gnu general public licen[cs]e
gpl | gpl | (?:gnu )?gpl(?: licen[cs]e)?
lgpl | gnu lesser general | gnu lesser general public licen[cs]e
lgpl | gnu library general | gnu library general public licen[cs]e
lgpl | lgpl | (?:gnu )?lgpl(?: licen[cs]e)?
agpl | gnu affero general | gnu affero general public licen[cs]e
agpl | agpl | (?:gnu )?agpl(?: licen[cs]e)?
gfdl | gnu free documentation | gnu free documentation licen[cs]e
mpl | mozilla public | mozilla public licen[cs]e
epl | eclipse public | eclipse public licen[cs]e
cddl | cddl | cddl
artistic | artistic | (?:perl )?artistic licen[cs]e
creative-commons | creative commons | creative commons(?: licen[cs]e)?
creative-commons | licen | cc licen[cs]e
cc0 | cc0 | cc0
public-domain | public domain | public domain
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
ofl | open font | (?:sil )?open font licen[cs]e
osl | open software | open software licen[cs]e
afl | academic free | academic free licen[cs]e
eupl | european union public | european union public licen[cs]e
cecill | cecill | cecill(?: licen[cs]e)?
php | php | php licen[cs]e
lppl | latex project | latex project public licen[cs]e
zpl | zope public | zope public licen[cs]e
npl | netscape public | netscape public licen[cs]e
sspl | server side public | server side public licen[cs]e
busl | business source | business source licen[cs]e
elastic | elastic | elastic licen[cs]e
copyleft | copyleft | copyleft
"""

#: Class 5: words that speak of rights without naming a licence.
HINTS = """
all-rights-reserved | all rights reserved | all rights reserved
all-rights-reserved | alle rechte | alle rechte vorbehalten
all-rights-reserved | droits r | tous droits réservés
all-rights-reserved | derechos reservados | todos los derechos reservados
open-source | open source | (?:an )?open source licen[cs]e
free-software | free software | free software licen[cs]e
dual-licensed | licen | dual licen[cs]ed
unnamed | licen | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:this|the|a|an) licen[cs]e
unnamed | licen | see (?:the )?licen[cs]e (?:file|txt|md)(?: for details)?
unnamed | licen | licen[cs]e agreement
"""

WEIGHTS = (1.0, 0.9375, 0.8125, 0.625, 0.25)


def families() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority) of names that come in every version and variant: the GNU licences and those of Creative Commons."""
    out = []
    gnu = {"gpl": ("general public", ("1.0", "2.0", "3.0")), "lgpl": ("(?:lesser|library) general public", ("2.0", "2.1", "3.0")), "agpl": ("affero general public", ("1.0", "3.0")), "gfdl": ("free documentation", ("1.1", "1.2", "1.3"))}
    for short, (name, versions) in gnu.items():
        for version in versions:
            number = version.replace(".", " ") if not version.endswith(".0") else version[0] + "(?: 0)?"
            keyword = f"gnu {name}" if short in ("gpl", "agpl", "gfdl") else "general public"
            long, tight = rf"gnu {name} licen[cs]e(?: {short})? {{v}}{number}", rf"(?:gnu )?{short} ?{{v}}{number}"
            out += [(f"{short}-{version}", keyword, long, 3), (f"{short}-{version}", short, tight, 3)]
            out += [(f"{short}-{version}-or-later", keyword, rf"{long} or (?:at your option )?(?:any )?later(?: version)?", 2), (f"{short}-{version}-or-later", short, rf"{tight} or (?:any )?later", 2)]
            out += [(f"{short}-{version}-only", short, rf"{tight} only", 2), (f"{short}-{version}-or-later", "spdx", rf"spdx license identifier {short} {number} or later", 1), (f"{short}-{version}-only", "spdx", rf"spdx license identifier {short} {number} only", 1)]
    words = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        long = "creative commons " + " ".join(words[k] for k in kind.split("-"))
        short = "cc " + kind.replace("-", " ")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ") if not version.endswith(".0") else version[0] + "(?: 0)?"
            out += [(f"cc-{kind}-{version}", "creative commons", rf"{long} {{v}}{number}(?: international| unported| generic)?", 2), (f"cc-{kind}-{version}", f"cc {kind[:2]}", rf"{short} {{v}}{number}(?: international| unported| generic)?", 2)]
            out += [(f"cc-{kind}-{version}", "creativecommons org", rf"creativecommons org licenses {kind.replace('-', ' ')} {version.replace('.', ' ')}", 1)]
        out += [(f"cc-{kind}", "creative commons", long, 3), (f"cc-{kind}", f"cc {kind[:2]}", short, 3)]
    return out


def rules() -> list[Rule]:
    """All rules, in the order of their numbers."""
    rows = [(*(x.strip() for x in line.split(" | ")), priority) for priority, text in enumerate((IDENTIFIERS, SENTENCES, NAMES, BARE, HINTS), 1) for line in text.strip().split("\n")]
    return [Rule(n, label, keyword, pattern.replace("{v}", VERSION), priority, WEIGHTS[priority - 1]) for n, (label, keyword, pattern, priority) in enumerate(rows + families())]
