"""Signature rules of license texts, in order of kind.

A line is ``label | keyword | expression``: the keyword is a plain string that every match
holds (the prefilter), the expression a regular expression over text with A-Z lower-cased. A
blank in an expression stands for any run of white space and comment signs. Matches begin and
end at word boundaries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kinds from the most to the least telling; the place is the priority, the figure the weight.
KINDS = {"notice": 0.97, "tag": 0.95, "name": 0.9, "url": 0.85, "family": 0.6, "mention": 0.3}

#: What licenses say of themselves.
NOTICES = r"""
apache-2.0 | apache | licensed under the apache licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?
apache-2.0 | apache | may not use this file except in compliance with the (?:apache )?licen[cs]e[.,]? [^|]{0,120}?apache
apache-1.1 | apache | licensed under the apache software licen[cs]e,? (?:version|v\.?) ?1\.1
mit | licen | (?:released|licensed|distributed|available|published|provided) under the (?:terms of the )?(?:mit|expat) licen[cs]e
mit | permission is hereby granted, free | permission is hereby granted, free of charge, to any person obtaining a copy
mit-0 | without restriction | to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.
isc | permission to use, copy, modify | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | bsd | (?:released|licensed|distributed) under the (?:zero[- ]clause|0[- ]clause) bsd licen[cs]e
bsd-2-clause | bsd | (?:released|licensed|distributed|governed) (?:under|by) (?:the |a )?(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd
bsd-3-clause | bsd | (?:released|licensed|distributed|governed) (?:under|by) (?:the |a )?(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd
bsd-3-clause | neither the name | neither the names? of [^|]{1,120}? nor the names of (?:its|their) contributors may be used to endorse
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd | bsd | (?:governed|covered|licensed|released|distributed) (?:under|by) (?:the |a )bsd(?:[- ]style)? licen[cs]e
bsd | redistribution | redistribution and use in source and binary forms,? with or without modification,? are permitted
gpl-2.0 | general public | gnu general public licen[cs]e(?: as published by the free software foundation)?[;,]? (?:either )?(?:version|v\.?) ?2(?:\.0)?
gpl-3.0 | general public | gnu general public licen[cs]e(?: as published by the free software foundation)?[;,]? (?:either )?(?:version|v\.?) ?3(?:\.0)?
gpl-2.0-or-later | general public | (?:gnu )?general public licen[cs]e[^|]{0,80}? (?:version|v\.?) ?2(?:\.0)?(?: of the licen[cs]e)?,? or \(?at your option\)? any later version
gpl-3.0-or-later | general public | (?:gnu )?general public licen[cs]e[^|]{0,80}? (?:version|v\.?) ?3(?:\.0)?(?: of the licen[cs]e)?,? or \(?at your option\)? any later version
lgpl-2.1 | lesser general | gnu lesser general public licen[cs]e[^|]{0,60}? (?:version|v\.?) ?2\.1
lgpl-3.0 | lesser general | gnu lesser general public licen[cs]e[^|]{0,60}? (?:version|v\.?) ?3(?:\.0)?
lgpl-2.0 | library general | gnu library general public licen[cs]e[^|]{0,60}? (?:version|v\.?) ?2(?:\.0)?
agpl-3.0 | affero | gnu affero general public licen[cs]e[^|]{0,60}? (?:version|v\.?) ?3(?:\.0)?
fdl-1.3 | free documentation | gnu free documentation licen[cs]e[^|]{0,40}? (?:version|v\.?) ?1\.3
fdl-1.2 | free documentation | gnu free documentation licen[cs]e[^|]{0,40}? (?:version|v\.?) ?1\.2
mpl-2.0 | mozilla | subject to the terms of the mozilla public licen[cs]e,? (?:version|v\.?) ?2\.0
mpl-1.1 | mozilla | subject to the mozilla public licen[cs]e (?:version|v\.?) ?1\.1
epl-2.0 | eclipse | terms of the eclipse public licen[cs]e,? (?:version|v\.?)? ?2\.0
epl-1.0 | eclipse | terms of the eclipse public licen[cs]e,? (?:version|v\.?)? ?1\.0
cddl-1.0 | common development | terms of the common development and distribution licen[cs]e
artistic-2.0 | artistic | (?:under|terms of) the artistic licen[cs]e,? (?:version |v\.? ?)?2\.0
zlib | as-is | this software is provided 'as-is', without any express or implied warranty
unlicense | unencumbered | this is free and unencumbered software released into the public domain
boost-1.0 | boost | distributed under the boost software licen[cs]e,? (?:version|v\.?) ?1\.0
cc0-1.0 | waived | (?:the person who associated|has waived) [^|]{0,80}?all (?:copyright and|of (?:his|her|their)) [^|]{0,80}?rights
cc-by-4.0 | creative commons | creative commons attribution(?:[- ]international)? 4\.0(?: international)?(?: public)? licen[cs]e
cc-by-sa-4.0 | creative commons | creative commons attribution[- ]share ?-?alike 4\.0
cc-by-nc-4.0 | creative commons | creative commons attribution[- ]non-? ?commercial 4\.0
cc-by-nd-4.0 | creative commons | creative commons attribution[- ]no-? ?deriv(?:ative|s)(?:s|ive works)? 4\.0
cc-by-nc-sa-4.0 | creative commons | creative commons attribution[- ]non-? ?commercial[- ]share ?-?alike 4\.0
cc-by-nc-nd-4.0 | creative commons | creative commons attribution[- ]non-? ?commercial[- ]no-? ?deriv(?:ative|s)(?:s|ive works)? 4\.0
cc-by-sa-3.0 | creative commons | creative commons attribution[- ]share ?-?alike 3\.0
cc-by-3.0 | creative commons | creative commons attribution 3\.0
ogl-uk-3.0 | open government | contains public sector information licensed under the open government licen[cs]e v?3(?:\.0)?
odbl-1.0 | open database | made available under the open database licen[cs]e
ofl-1.1 | open font | licensed under the sil open font licen[cs]e,? (?:version|v\.?) ?1\.1
beerware | beer | you can buy me a beer in return
wtfpl | fuck | do what the fuck you want to
busl-1.1 | business source | business source licen[cs]e 1\.1
sspl-1.0 | server side | server side public licen[cs]e,? (?:version|v\.?) ?1
elastic-2.0 | elastic | elastic licen[cs]e 2\.0
proprietary | proprietary | (?:this|the) (?:software|document|material|source code|file) is (?:the )?(?:confidential and )?proprietary
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)[^|]{0,60}? (?:is|are) (?:strictly )?prohibited
no-warranty | warranty | without (?:any )?warrant(?:y|ies)(?: or conditions)? of any kind
no-warranty | merchantability | implied warrant(?:y|ies) of merchantability
"""

#: Names of licenses with their version.
NAMES = r"""
apache-2.0 | apache | apache(?:[- ]software)?(?:[- ]licen[cs]e)?,?[- ](?:version |v\.? ?)?2(?:\.0)?
apache-1.1 | apache | apache(?:[- ]software)? licen[cs]e,? (?:version |v\.? ?)?1\.1
apache-1.0 | apache | apache(?:[- ]software)? licen[cs]e,? (?:version |v\.? ?)?1\.0
mit | licen | (?:the )?mit(?:/x11)? licen[cs]e
mit | licen | expat licen[cs]e
mit-0 | attribution | mit no attribution
x11 | x11 | x11 licen[cs]e
isc | isc | isc licen[cs]e
0bsd | bsd | (?:0bsd|zero[- ]clause bsd(?: licen[cs]e)?)
bsd-2-clause | bsd | (?:bsd[- ]2[- ]clause|2[- ]clause bsd|two[- ]clause bsd|simplified bsd|freebsd licen[cs]e)
bsd-3-clause | bsd | (?:bsd[- ]3[- ]clause|3[- ]clause bsd|three[- ]clause bsd|new bsd|modified bsd|revised bsd)
bsd-4-clause | bsd | (?:bsd[- ]4[- ]clause|4[- ]clause bsd|four[- ]clause bsd|original bsd)
gpl-1.0 | gpl | (?:gnu )?gpl[- ]?(?:version |v\.? ?)?1(?:\.0)?
gpl-2.0 | gpl | (?:gnu )?gpl[- ]?(?:version |v\.? ?)?2(?:\.0)?
gpl-3.0 | gpl | (?:gnu )?gpl[- ]?(?:version |v\.? ?)?3(?:\.0)?
gpl-2.0-or-later | gpl | (?:gnu )?gpl[- ]?(?:v\.? ?)?2(?:\.0)?(?:\+|[- ]or[- ]later)
gpl-3.0-or-later | gpl | (?:gnu )?gpl[- ]?(?:v\.? ?)?3(?:\.0)?(?:\+|[- ]or[- ]later)
lgpl-2.0 | lgpl | (?:gnu )?lgpl[- ]?(?:version |v\.? ?)?2(?:\.0)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl[- ]?(?:version |v\.? ?)?2\.1
lgpl-3.0 | lgpl | (?:gnu )?lgpl[- ]?(?:version |v\.? ?)?3(?:\.0)?
agpl-3.0 | agpl | (?:gnu )?agpl[- ]?(?:version |v\.? ?)?3(?:\.0)?
fdl-1.2 | gfdl | gfdl[- ]?1\.2
fdl-1.3 | gfdl | gfdl[- ]?1\.3
mpl-1.0 | mpl | mpl[- ]?(?:version |v\.? ?)?1\.0
mpl-1.1 | mpl | mpl[- ]?(?:version |v\.? ?)?1\.1
mpl-2.0 | mpl | mpl[- ]?(?:version |v\.? ?)?2\.0
mpl-2.0 | mozilla | mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
epl-1.0 | eclipse | eclipse public licen[cs]e,?(?: -)? (?:version |v\.? ?)?1\.0
epl-2.0 | eclipse | eclipse public licen[cs]e,?(?: -)? (?:version |v\.? ?)?2\.0
edl-1.0 | eclipse | eclipse distribution licen[cs]e,?(?: -)? (?:version |v\.? ?)?1\.0
eupl-1.1 | european union public | european union public licen[cs]e,? (?:version |v\.? ?)?1\.1
eupl-1.2 | european union public | european union public licen[cs]e,? (?:version |v\.? ?)?1\.2
eupl-1.2 | eupl | eupl[- ]?(?:v\.? ?)?1\.2
cddl-1.0 | cddl | cddl[- ]?(?:version |v\.? ?)?1\.0
cddl-1.1 | cddl | cddl[- ]?(?:version |v\.? ?)?1\.1
cpl-1.0 | common public | common public licen[cs]e,? (?:version |v\.? ?)?1\.0
ipl-1.0 | ibm | ibm public licen[cs]e,? (?:version |v\.? ?)?1\.0
osl-3.0 | open software | open software licen[cs]e,? (?:version |v\.? ?)?3\.0
afl-3.0 | academic free | academic free licen[cs]e,? (?:version |v\.? ?)?3\.0
artistic-1.0 | artistic | artistic licen[cs]e,? (?:version |v\.? ?)?1\.0
artistic-2.0 | artistic | artistic licen[cs]e,? (?:version |v\.? ?)?2\.0
python-2.0 | python | python (?:software foundation )?licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
php-3.01 | php | php licen[cs]e,? (?:version |v\.? ?)?3\.01
ruby | ruby | ruby licen[cs]e
ncsa | ncsa | (?:university of illinois/)?ncsa open source licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
apsl-2.0 | apple | apple public source licen[cs]e,? (?:version |v\.? ?)?2\.0
zlib | zlib | zlib(?:/libpng)? licen[cs]e
libpng | libpng | libpng licen[cs]e
openssl | openssl | openssl licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
curl | curl | curl licen[cs]e
boost-1.0 | boost | boost software licen[cs]e,?(?: -)? (?:version |v\.? ?)?1\.0
upl-1.0 | universal permissive | universal permissive licen[cs]e,? (?:version |v\.? ?)?1\.0
ecl-2.0 | educational | educational community licen[cs]e,? (?:version |v\.? ?)?2\.0
lppl-1.3 | latex | latex project public licen[cs]e,? (?:version |v\.? ?)?1\.3
mulan-2.0 | mulan | mulan psl ?v2
blueoak-1.0 | blue oak | blue oak model licen[cs]e(?: 1\.0\.0)?
parity-7.0 | parity | parity public licen[cs]e 7\.0
polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter)(?: licen[cs]e)?
commons-clause | commons clause | commons clause(?: licen[cs]e condition)?
unlicense | unlicen | (?:the )?unlicen[cs]e
wtfpl | wtfpl | wtfpl
cc0-1.0 | cc0 | cc0(?:[- ]?1\.0)?(?: universal)?
cc-by-2.0 | cc | cc[- ]by[- ]2\.0
cc-by-2.5 | cc | cc[- ]by[- ]2\.5
cc-by-3.0 | cc | cc[- ]by[- ]3(?:\.0)?
cc-by-4.0 | cc | cc[- ]by[- ]4(?:\.0)?
cc-by-sa-2.0 | cc | cc[- ]by[- ]sa[- ]2\.0
cc-by-sa-3.0 | cc | cc[- ]by[- ]sa[- ]3(?:\.0)?
cc-by-sa-4.0 | cc | cc[- ]by[- ]sa[- ]4(?:\.0)?
cc-by-nc-2.0 | cc | cc[- ]by[- ]nc[- ]2\.0
cc-by-nc-3.0 | cc | cc[- ]by[- ]nc[- ]3(?:\.0)?
cc-by-nc-4.0 | cc | cc[- ]by[- ]nc[- ]4(?:\.0)?
cc-by-nd-3.0 | cc | cc[- ]by[- ]nd[- ]3(?:\.0)?
cc-by-nd-4.0 | cc | cc[- ]by[- ]nd[- ]4(?:\.0)?
cc-by-nc-sa-3.0 | cc | cc[- ]by[- ]nc[- ]sa[- ]3(?:\.0)?
cc-by-nc-sa-4.0 | cc | cc[- ]by[- ]nc[- ]sa[- ]4(?:\.0)?
cc-by-nc-nd-3.0 | cc | cc[- ]by[- ]nc[- ]nd[- ]3(?:\.0)?
cc-by-nc-nd-4.0 | cc | cc[- ]by[- ]nc[- ]nd[- ]4(?:\.0)?
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e
odbl-1.0 | odbl | odbl(?:[- ]?1\.0)?
pddl-1.0 | pddl | pddl(?:[- ]?1\.0)?
cdla-permissive-2.0 | cdla | cdla[- ]permissive[- ]2\.0
cdla-sharing-1.0 | cdla | cdla[- ]sharing[- ]1\.0
ofl-1.1 | open font | sil open font licen[cs]e
openrail-m | rail | (?:bigscience |creativeml )?open ?rail(?:[-+]{1,2}m)?(?: licen[cs]e)?
llama-2 | llama | llama ?2 community licen[cs]e
"""

#: Names without a version, and families of licenses.
FAMILIES = r"""
apache | apache | apache(?:[- ]software)? licen[cs]e
bsd | bsd | bsd(?:[- ]style|[- ]type)? licen[cs]e
gpl | general public | (?:gnu )?general public licen[cs]e
gpl | gpl | (?:gnu )?gpl
lgpl | lgpl | (?:gnu )?lgpl
lgpl | lesser general | (?:gnu )?lesser general public licen[cs]e
agpl | agpl | (?:gnu )?agpl
agpl | affero | (?:gnu )?affero general public licen[cs]e
fdl | free documentation | (?:gnu )?free documentation licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cddl | common development | common development and distribution licen[cs]e
artistic | artistic | artistic licen[cs]e
python | python | python (?:software foundation )?licen[cs]e
cc | creative commons | creative commons(?: licen[cs]e)?
cc-by | creative commons | creative commons attribution(?: licen[cs]e)?
cc-by-sa | cc | cc[- ]by[- ]sa
cc-by-nc | cc | cc[- ]by[- ]nc
cc-by-nd | cc | cc[- ]by[- ]nd
cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa
cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd
cc-by | cc | cc[- ]by
ogl | open government | open government licen[cs]e
public-domain | public domain | (?:released into|dedicated to|placed in|in) the public domain
public-domain | gemeinfrei | gemeinfrei
public-domain | domaine public | (?:dans le|du) domaine public
public-domain | dominio público | (?:de|del|al) dominio público
proprietary | proprietary | proprietary (?:and confidential|licen[cs]e|software|information)
commercial | commercial licen | commercial licen[cs]e
eula | end user licen | end[- ]user licen[cs]e agreement
eula | eula | eula
source-available | source available | source[- ]available licen[cs]e
"""

#: Addresses of license texts; dots stand for themselves in most readers' eyes, so none is left bare.
URLS = r"""
apache-2.0 | apache.org | apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache-1.1 | apache.org | apache\.org/licenses/license-1\.1
apache | apache.org | apache\.org/licenses
mit | opensource.org | opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
bsd-2-clause | opensource.org | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | opensource.org | opensource\.org/licenses?/bsd-3-clause
isc | opensource.org | opensource\.org/licenses?/isc
artistic-2.0 | opensource.org | opensource\.org/licenses?/artistic-2\.0
apache-2.0 | opensource.org | opensource\.org/licenses?/apache-2\.0
mit | mit-license.org | mit-license\.org
gpl-2.0 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.txt|\.html)?
gpl-3.0 | gnu.org | gnu\.org/licenses/gpl-3\.0(?:\.txt|\.html)?
gpl | gnu.org | gnu\.org/(?:licenses/gpl|copyleft/gpl)(?:\.txt|\.html)?
lgpl-2.1 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.txt|\.html)?
lgpl-3.0 | gnu.org | gnu\.org/licenses/lgpl-3\.0(?:\.txt|\.html)?
lgpl | gnu.org | gnu\.org/(?:licenses|copyleft)/lgpl(?:\.txt|\.html)?
agpl-3.0 | gnu.org | gnu\.org/licenses/agpl-3\.0(?:\.txt|\.html)?
fdl | gnu.org | gnu\.org/licenses/fdl(?:-1\.[123])?(?:\.txt|\.html)?
mpl-2.0 | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mozilla.org | mozilla\.org/mpl/mpl-1\.1(?:\.txt|\.html)?
epl-1.0 | eclipse.org | eclipse\.org/legal/epl-v10(?:\.html)?
epl-2.0 | eclipse.org | eclipse\.org/legal/epl-(?:2\.0|v20)(?:\.html)?
boost-1.0 | boost.org | boost\.org/license_1_0\.txt
unlicense | unlicense.org | unlicense\.org
wtfpl | wtfpl.net | wtfpl\.net
ofl-1.1 | sil.org | scripts\.sil\.org/ofl
ogl-uk-3.0 | nationalarchives | nationalarchives\.gov\.uk/doc/open-government-licence/version/3
odbl-1.0 | opendatacommons | opendatacommons\.org/licenses/odbl(?:/1\.0|/1-0)?
odc-by-1.0 | opendatacommons | opendatacommons\.org/licenses/by(?:/1\.0|/1-0)?
pddl-1.0 | opendatacommons | opendatacommons\.org/licenses/pddl(?:/1\.0|/1-0)?
cc0-1.0 | creativecommons | creativecommons\.org/publicdomain/zero/1\.0
public-domain | creativecommons | creativecommons\.org/(?:publicdomain/mark/1\.0|licenses/publicdomain)
cc-by-2.0 | creativecommons | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | creativecommons | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | creativecommons | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | creativecommons | creativecommons\.org/licenses/by/4\.0
cc-by-sa-2.0 | creativecommons | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-3.0 | creativecommons | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | creativecommons | creativecommons\.org/licenses/by-sa/4\.0
cc-by-nc-4.0 | creativecommons | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nd-4.0 | creativecommons | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-4.0 | creativecommons | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4.0 | creativecommons | creativecommons\.org/licenses/by-nc-nd/4\.0
cc | creativecommons | creativecommons\.org/licenses
spdx | spdx.org | spdx\.org/licenses
"""

#: Words that speak of rights without naming a license.
MENTIONS = r"""
reserved | rights reserved | all rights reserved
reserved | rights reserved | some rights reserved
reserved | rechte vorbehalten | alle rechte vorbehalten
reserved | droits réservés | tous droits réservés
reserved | derechos reservados | todos los derechos reservados
reserved | diritti riservati | tutti i diritti riservati
copyright | copyright | copyright (?:\(c\)|©) ?[0-9]{4}(?: ?[-–,] ?[0-9]{4})*
copyright | copyright | (?:\(c\)|©) copyright
copyright | copyright | copyright(?:ed)? [0-9]{4}
copyright | © | © ?[0-9]{4}
licensed | licen | (?:licensed|licenced) (?:under|to|by|from)
licensed | licen | (?:released|distributed|published|available) under (?:the|a|an)(?: [a-z0-9.]+){0,4} licen[cs]e
licensed | licen | licen[cs]e agreement
licensed | licen | see (?:the )?licen[cs]e(?:\.txt|\.md| file)?
licensed | lizenz | (?:unter|gemäß) (?:der|einer)(?: [a-zà-ÿ0-9.-]+){0,3}(?:-| )lizenz
licensed | lizenz | lizenziert unter
licensed | licence | sous licence
licensed | licencia | (?:bajo|con) (?:la )?licencia
open-source | open source | open[- ]source licen[cs]e
free-software | free software | free software licen[cs]e
copyleft | copyleft | copyleft
"""

_SECTIONS = {"notice": NOTICES, "name": NAMES, "family": FAMILIES, "url": URLS, "mention": MENTIONS}
_GAP = r"[\s*#/]+"


@dataclass(frozen=True)
class Rule:
    """``order`` is the place in the list; a smaller ``priority`` prevails."""

    order: int
    priority: int
    kind: str
    label: str
    keyword: str
    pattern: str
    weight: float


def _expression(text: str) -> str:
    """Blanks become gaps (outside classes as they stand inside), ends become word boundaries."""
    body = re.sub(r"\[- \]", r"(?:-|" + _GAP.replace("\\", r"\\") + ")", text)
    body = re.sub(r" \?", f"(?:{_GAP})?".replace("\\", r"\\"), body)
    body = body.replace(" ", _GAP)
    return f"(?<![0-9a-z\\u0080-\\uffff]){body}(?![0-9a-z\\u0080-\\uffff])"


def rules() -> list[Rule]:
    """All rules in order: a tag for each versioned label, and the lines above."""
    out: list[Rule] = []
    kinds = list(KINDS)
    for kind in kinds:
        if kind == "tag":
            labels = sorted({line.split(" | ")[0] for line in NAMES.strip().splitlines()})
            lines = [
                f"{x} | spdx | spdx-license-identifier: ?(?:[(] ?)?{re.escape(x)}(?:-only)?" for x in labels
            ]
        else:
            lines = _SECTIONS[kind].strip().splitlines()
        for line in lines:
            label, keyword, text = line.split(" | ", 2)
            out.append(Rule(len(out), kinds.index(kind), kind, label, keyword, _expression(text), KINDS[kind]))
    return out
