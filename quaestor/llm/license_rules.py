"""License signature rules, written over words.

A text is read as lower-case words parted by single spaces ("v2.0" is the words "v2 0").
Each entry: label, rank, keyword, pattern. The keyword is a word that every match of the
pattern holds; a rule is tried only on texts that have it. Ranks, strongest first: 1 SPDX tag,
2 grant or warranty sentence, 3 address, 4 full name, 5 short name.
"""

from __future__ import annotations

import re

# SPDX identifiers; each gives one rule of rank 1, made below.
SPDX_IDS = """
0BSD AFL-3.0 AGPL-1.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0
CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0
CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1
CDLA-Permissive-2.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C ClArtistic CPAL-1.0 CPL-1.0 curl ECL-2.0
EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0-only
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IJG Intel IPL-1.0 ISC
LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c
MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0
OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat
SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()

# label | rank | keyword | pattern
_HAND = r"""
mit | 2 | sublicense | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .{0,200}?sublicense
mit | 2 | mit | (?:released|licensed|distributed|available|published|provided) (?:under|with) (?:the )?(?:terms of the )?mit licen[sc]e
mit | 2 | mit | (?:code|software|project|work|package) is (?:mit licensed|mit)
mit | 3 | mit | opensource org licenses mit
mit | 3 | mit | (?:www )?opensource org licenses mit license php
mit | 4 | mit | mit (?:x11 |expat |style )?licen[sc]e
mit | 4 | expat | expat licen[sc]e
mit | 5 | mit | mit licensed
mit-0 | 4 | mit | mit no attribution
x11 | 4 | x11 | x11 licen[sc]e
isc | 2 | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 4 | isc | isc licen[sc]e
0bsd | 4 | 0bsd | (?:zero clause bsd|0bsd licen[sc]e|0bsd)
0bsd | 4 | bsd | zero clause bsd(?: licen[sc]e)?
apache-2.0 | 2 | apache | licensed under the apache licen[sc]e version 2 0(?: the license)?
apache-2.0 | 2 | apache | (?:released|distributed|available|provided) under (?:the )?(?:terms of the )?apache (?:software )?licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?
apache-2.0 | 3 | apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 4 | apache | apache (?:software )?licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?
apache-2.0 | 5 | apache | apache 2(?: 0)? licen[sc]ed?
apache-1.1 | 4 | apache | apache (?:software )?licen[sc]e (?:version )?1 1
apache-1.0 | 4 | apache | apache (?:software )?licen[sc]e (?:version )?1 0
apache-other | 4 | apache | apache (?:software )?licen[sc]e
gpl-3.0 | 2 | gnu | (?:this )?(?:work|program|software|file|project) is (?:free software you can redistribute it and or modify it|licensed) under the (?:terms of the )?gnu general public licen[sc]e(?: as published by the free software foundation either)? version 3
gpl-3.0 | 2 | gnu | licensed under the gnu general public licen[sc]e version 3(?: 0)?
gpl-3.0 | 3 | gnu | (?:www )?gnu org licenses gpl 3 0(?: txt| html)?
gpl-3.0 | 4 | gnu | gnu general public licen[sc]e (?:version |v )?(?:3|v3)(?: 0)?
gpl-3.0 | 5 | gplv3 | (?:gnu )?gplv3
gpl-3.0 | 5 | gpl | (?:gnu )?gpl (?:version |v )?(?:3|v3)(?: 0)?
gpl-2.0 | 2 | gnu | licensed under the gnu general public licen[sc]e version 2(?: 0)?
gpl-2.0 | 2 | gnu | gnu general public licen[sc]e as published by the free software foundation either version 2
gpl-2.0 | 3 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl-2.0 | 4 | gnu | gnu general public licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?
gpl-2.0 | 5 | gplv2 | (?:gnu )?gplv2
gpl-2.0 | 5 | gpl | (?:gnu )?gpl (?:version |v )?(?:2|v2)(?: 0)?
gpl-1.0 | 4 | gnu | gnu general public licen[sc]e (?:version |v )?1(?: 0)?
gpl-other | 2 | gnu | under the terms of the gnu general public licen[sc]e
gpl-other | 4 | public | (?:gnu )?general public licen[sc]e
gpl-other | 5 | gpl | (?:gnu )?gpl(?: licen[sc]ed?)?
lgpl-3.0 | 3 | gnu | (?:www )?gnu org licenses lgpl 3 0(?: txt| html)?
lgpl-3.0 | 4 | lesser | (?:gnu )?lesser general public licen[sc]e (?:version |v )?(?:3|v3)(?: 0)?
lgpl-3.0 | 5 | lgplv3 | lgplv3
lgpl-3.0 | 5 | lgpl | lgpl (?:version |v )?(?:3|v3)(?: 0)?
lgpl-2.1 | 3 | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
lgpl-2.1 | 4 | lesser | (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1
lgpl-2.1 | 5 | lgpl | lgpl (?:version |v )?2 1
lgpl-2.0 | 4 | library | (?:gnu )?library general public licen[sc]e(?: version 2(?: 0)?)?
lgpl-other | 4 | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl-other | 5 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 3 | agpl | (?:www )?gnu org licenses agpl 3 0(?: txt| html)?
agpl-3.0 | 4 | affero | (?:gnu )?affero general public licen[sc]e(?: (?:version |v )?(?:3|v3)(?: 0)?)?
agpl-3.0 | 5 | agplv3 | agplv3
agpl-3.0 | 5 | agpl | (?:gnu )?agpl(?: (?:version |v )?(?:3|v3)(?: 0)?)?
gfdl | 3 | gnu | (?:www )?gnu org (?:copyleft|licenses) fdl(?: 1 3)?(?: html)?
gfdl | 4 | documentation | (?:gnu )?free documentation licen[sc]e(?: version 1 [0-9])?
gfdl | 5 | gfdl | gfdl
bsd-2-clause | 3 | bsd | opensource org licenses bsd 2 clause
bsd-2-clause | 4 | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | 4 | bsd | bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause | 4 | freebsd | freebsd licen[sc]e
bsd-2-clause | 4 | bsd | simplified bsd licen[sc]e
bsd-3-clause | 2 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 3 | bsd | opensource org licenses bsd 3 clause
bsd-3-clause | 4 | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | 4 | bsd | bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause | 4 | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause | 2 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | 4 | bsd | (?:original bsd licen[sc]e|(?:4|four) clause bsd|bsd (?:4|four) clause)
bsd-other | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-other | 4 | bsd | (?:berkeley )?bsd (?:style )?licen[sc]e
bsd-other | 5 | bsd | bsd licensed
mpl-2.0 | 2 | mozilla | subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0
mpl-2.0 | 3 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2.0 | 4 | mozilla | mozilla public licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?
mpl-1.1 | 4 | mozilla | mozilla public licen[sc]e (?:version |v )?1 1
mpl-1.0 | 4 | mozilla | mozilla public licen[sc]e (?:version |v )?1 0
mpl-other | 4 | mozilla | mozilla public licen[sc]e
mpl-other | 5 | mpl | mpl(?: (?:version |v )?[12] [01])?
npl | 4 | netscape | netscape public licen[sc]e
epl-2.0 | 3 | epl | (?:www )?eclipse org (?:legal|org documents) epl 2 0(?: txt| html)?
epl-2.0 | 4 | eclipse | eclipse public licen[sc]e (?:version |v )?2 0
epl-1.0 | 3 | epl | (?:www )?eclipse org (?:legal|org documents) epl v10(?: html)?
epl-1.0 | 4 | eclipse | eclipse public licen[sc]e (?:version |v )?1 0
epl-other | 4 | eclipse | eclipse public licen[sc]e
cpl-1.0 | 4 | common | common public licen[sc]e(?: version 1 0)?
cpal-1.0 | 4 | attribution | common public attribution licen[sc]e(?: version 1 0)?
cddl-1.0 | 4 | cddl | cddl(?: (?:version |v )?1 [01])?
cddl-1.0 | 4 | distribution | common development and distribution licen[sc]e(?: version 1 [01])?
eupl | 4 | european | european union public licen[sc]e(?: v(?:ersion)? 1 [0-2])?
eupl | 5 | eupl | eupl(?: v?(?:ersion )?1 [0-2])?
cecill | 4 | cecill | cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?(?: (?:version )?2 [01])?
cc0-1.0 | 3 | publicdomain | creativecommons org publicdomain zero 1 0
cc0-1.0 | 4 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 4 | creative | creative commons zero(?: v?1 0)?(?: universal)?
cc-by-4.0 | 3 | creativecommons | creativecommons org licenses by 4 0
cc-by-4.0 | 4 | cc | cc by 4 0
cc-by-4.0 | 4 | creative | creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-3.0 | 3 | creativecommons | creativecommons org licenses by 3 0
cc-by-3.0 | 4 | cc | cc by 3 0
cc-by-3.0 | 4 | creative | creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-other | 4 | cc | cc by(?: [12] [05])?
cc-by-other | 4 | creative | creative commons attribution(?: licen[sc]e)?
cc-by-sa-4.0 | 3 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | 4 | cc | cc by sa 4 0
cc-by-sa-4.0 | 4 | creative | creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-3.0 | 3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | 4 | cc | cc by sa 3 0
cc-by-sa-other | 4 | cc | cc by sa(?: [12] [05])?
cc-by-sa-other | 4 | creative | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nc-4.0 | 2 | cc | licensed under cc by nc 4 0
cc-by-nc-4.0 | 3 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 4 | cc | cc by nc 4 0
cc-by-nc-4.0 | 4 | creative | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-other | 4 | cc | cc by nc(?: [123] [05])?
cc-by-nc-sa-4.0 | 3 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | 4 | cc | cc by nc sa 4 0
cc-by-nc-sa-other | 4 | cc | cc by nc sa(?: [123] [05])?
cc-by-nc-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | 4 | cc | cc by nc nd 4 0
cc-by-nc-nd-other | 4 | cc | cc by nc nd(?: [123] [05])?
cc-by-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nd-4.0 | 4 | cc | cc by nd 4 0
cc-by-nd-other | 4 | cc | cc by nd(?: [123] [05])?
cc-other | 4 | creative | creative commons(?: licen[sc]e)?
cc-other | 3 | creativecommons | creativecommons org(?: licenses)?
public-domain | 2 | domain | (?:is|are|been) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 4 | domain | public domain(?: dedication| mark)?
unlicense | 2 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | unlicense org
unlicense | 4 | unlicense | (?:the )?unlicense
wtfpl | 4 | wtfpl | wtfpl(?: (?:version )?2)?
zlib | 2 | misrepresented | the origin of this software must not be misrepresented
zlib | 4 | zlib | zlib (?:libpng )?licen[sc]e
libpng | 4 | libpng | libpng licen[sc]e
bsl-1.0 | 3 | boost | (?:www )?boost org license 1 0 txt
bsl-1.0 | 4 | boost | boost software licen[sc]e(?: version 1 0)?
busl-1.1 | 4 | business | business source licen[sc]e(?: (?:version )?1 1)?
sspl-1.0 | 4 | server | server side public licen[sc]e(?: v(?:ersion)? ?1)?
sspl-1.0 | 5 | sspl | sspl(?: v?1)?
elastic-2.0 | 4 | elastic | elastic licen[sc]e(?: (?:version )?(?:2|v2)(?: 0)?)?
artistic-2.0 | 4 | artistic | artistic licen[sc]e (?:version )?2 0
artistic-1.0 | 4 | artistic | artistic licen[sc]e (?:version )?1 0
artistic-other | 4 | artistic | (?:clarified )?artistic licen[sc]e
perl | 2 | perl | under the same terms as perl itself
ofl-1.1 | 3 | ofl | scripts sil org ofl
ofl-1.1 | 4 | sil | sil open font licen[sc]e(?: version 1 1)?
ofl-1.1 | 4 | font | open font licen[sc]e(?: version 1 1)?
ms-pl | 4 | microsoft | microsoft public licen[sc]e
ms-rl | 4 | microsoft | microsoft reciprocal licen[sc]e
psf-2.0 | 4 | python | python software foundation licen[sc]e(?: version 2)?
python-2.0 | 4 | python | python licen[sc]e
php-3.01 | 4 | php | php licen[sc]e(?: version 3(?: 0| 01)?)?
ruby | 4 | ruby | ruby licen[sc]e
ruby | 2 | ruby | under the same terms as ruby
postgresql | 4 | postgresql | postgresql licen[sc]e
openssl | 4 | openssl | openssl licen[sc]e
openssl | 2 | openssl | developed by the openssl project for use in the openssl toolkit
curl | 4 | curl | curl licen[sc]e
vim | 4 | vim | vim licen[sc]e
ncsa | 4 | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[sc]e
w3c | 4 | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
icu | 4 | icu | icu licen[sc]e
ijg | 2 | jpeg | this software is based in part on the work of the independent jpeg group
ftl | 4 | freetype | freetype (?:project )?licen[sc]e
lppl | 4 | latex | latex project public licen[sc]e(?: version 1 [0-3])?
lppl | 5 | lppl | lppl(?: 1 3c?)?
odbl-1.0 | 3 | opendatacommons | (?:www )?opendatacommons org licenses odbl(?: 1 0)?
odbl-1.0 | 4 | database | open (?:data commons open )?database licen[sc]e(?: v?1 0)?
odc-by-1.0 | 4 | data | open data commons attribution licen[sc]e
pddl-1.0 | 4 | data | open data commons public domain dedication(?: and)? licen[sc]e
cdla | 4 | community | community data licen[sc]e agreement
upl-1.0 | 4 | universal | universal permissive licen[sc]e
osl-3.0 | 4 | open | open software licen[sc]e(?: version 3 0)?
afl-3.0 | 4 | academic | academic free licen[sc]e(?: version [23] [01])?
ecl-2.0 | 4 | educational | educational community licen[sc]e(?: version 2 0)?
ipl-1.0 | 4 | ibm | ibm public licen[sc]e(?: version 1 0)?
qpl-1.0 | 4 | public | q public licen[sc]e
sissl | 4 | sun | sun industry standards source licen[sc]e
apsl-2.0 | 4 | apple | apple public source licen[sc]e
zpl | 4 | zope | zope public licen[sc]e
sleepycat | 4 | sleepycat | sleepycat licen[sc]e
mulan | 4 | mulan | mulan (?:psl|permissive software licen[sc]e)(?: v?2)?
blueoak | 4 | oak | blue oak model licen[sc]e(?: 1 0 0)?
json | 2 | evil | the software shall be used for good not evil
beerware | 4 | beerware | (?:the )?beerware licen[sc]e
proprietary | 2 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 2 | eula | eula
proprietary | 2 | agreement | end user licen[sc]e agreement
proprietary | 2 | unauthorized | unauthorized (?:copying|reproduction|use|distribution) (?:of this file |of this software )?(?:via any medium )?is (?:strictly )?prohibited
proprietary | 4 | reserved | all rights reserved
commercial | 4 | commercial | commercial licen[sc]e
non-commercial | 2 | commercial | (?:for )?non commercial use only
"""


def _word_pattern(pattern: str) -> str:
    """The pattern for texts whose words carry positions: each word is followed by ':' and its number."""
    wild = re.sub(r"\.\{0,(\d+)\}\?", r"(?:[^ ]+ ){0,\1}?", pattern)
    spaced = wild.replace(" ?", "\x00").replace("[^ ]", "\x01").replace(" ", r":\d+ ")
    spaced = spaced.replace("\x00", r"(?::\d+ )?").replace("\x01", "[^ ]")
    spaced = spaced.replace(r"[^ ]+:\d+ ", "[^ ]+ ")
    return rf" (?:{spaced}):\d+(?= |$)"


def rules() -> list[tuple[int, str, int, str, str]]:
    """(order, label, rank, keyword, pattern over numbered words), in table order."""
    table = [tuple(x.strip() for x in line.split("|", 3)) for line in _HAND.strip().splitlines()]
    for name in SPDX_IDS:
        words = re.sub("[^a-z0-9]+", " ", name.lower()).strip()
        table.append((name.lower(), "1", "spdx", f"spdx license identifier {words}"))
    out = []
    for order, (label, rank, keyword, pattern) in enumerate(table):
        out.append((order, label, int(rank), keyword, _word_pattern(pattern)))
    return out
