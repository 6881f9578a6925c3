"""License signatures: one line a rule, hand-written.

``label | priority | keywords | pattern``. Patterns run over lower-cased words
with one blank between them; a blank matches the gap between words, and an
optional word holds its blank; one- and two-word spellings are alternatives. All
keywords must occur in a text before its pattern is tried, so each stands in every
spelling that the pattern allows. ``{v}`` stands for the spellings before a version (``version 2``, ``v 2``, ``v2``, ``2``). Priority: 3 notices and headers, 2 named licenses with a
version or variant, 1 names alone.
"""

from __future__ import annotations

#: Labels that are given wherever their phrase stands, and are never suppressed.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: What may stand between a name and its version.
VERSION = "(version |v |v)?"

RULES = r"""
apache-2.0 | 3 | licensed apache | licensed under (the )?apache license version 2 0
apache-2.0 | 3 | spdx apache | spdx license identifier apache 2 0
apache-2.0 | 3 | apache org | www apache org licenses license 2 0
apache-2.0 | 2 | apache | apache license {v}2( 0)?
apache-2.0 | 2 | apache | apache software license {v}2( 0)?
apache-2.0 | 2 | apache | apache 2 0( license)?
apache-2.0 | 2 | apache licence | apache licence {v}2( 0)?
apache-1.1 | 2 | apache | apache (software )?license {v}1 1
apache-1.0 | 2 | apache | apache (software )?license {v}1 0
apache | 1 | apache | apache (software )?licen[cs]e
apache | 1 | asf | asf licen[cs]e
mit | 3 | released mit | released under the mit license
mit | 3 | licensed mit | licensed under the mit license
mit | 3 | spdx mit | spdx license identifier mit
mit | 3 | permission hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 3 | merchantability noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 2 | mit | (the )?mit licen[cs]e
mit | 2 | expat | expat licen[cs]e
mit | 2 | mit | mit style licen[cs]e
mit | 2 | opensource mit | opensource org licenses mit
mit-0 | 2 | mit attribution | mit no attribution( license)?
x11 | 2 | x11 | (the )?(mit )?x11 licen[cs]e
isc | 3 | permission fee granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | spdx isc | spdx license identifier isc
isc | 2 | isc | (the )?isc licen[cs]e
0bsd | 3 | spdx 0bsd | spdx license identifier 0bsd
0bsd | 2 | 0bsd | 0bsd( license)?
0bsd | 2 | bsd zero | zero clause bsd( license)?
bsd-2-clause | 3 | spdx bsd | spdx license identifier bsd 2 clause
bsd-2-clause | 2 | bsd clause | bsd 2 clause( license)?
bsd-2-clause | 2 | bsd clause | (2|two) clause bsd( license)?
bsd-2-clause | 2 | simplified bsd | simplified bsd licen[cs]e
bsd-2-clause | 2 | freebsd | freebsd licen[cs]e
bsd-3-clause | 3 | spdx bsd | spdx license identifier bsd 3 clause
bsd-3-clause | 3 | endorse | neither the name of (\S+ ){1,24}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause | 2 | bsd clause | bsd 3 clause( (new|clear))?( license)?
bsd-3-clause | 2 | bsd clause | (3|three) clause bsd( license)?
bsd-3-clause | 2 | bsd | (new|revised|modified) bsd licen[cs]e
bsd-4-clause | 2 | bsd clause | bsd 4 clause( license)?
bsd-4-clause | 2 | bsd clause | (4|four) clause bsd( license)?
bsd-4-clause | 2 | original bsd | original bsd licen[cs]e
bsd-4-clause | 3 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | 3 | redistribution source binary | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | redistributions retain | redistributions of source code must retain the above copyright notice
bsd | 3 | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice
bsd | 1 | bsd | bsd (style )?licen[cs]e
gpl-3.0 | 3 | licensed gnu general | licensed under the gnu general public license version 3
gpl-3.0-or-later | 3 | gnu general later | gnu general public license (\S+ ){0,16}either version 3 of the license or (at your option )?any later version
gpl-3.0-or-later | 3 | spdx gpl | spdx license identifier gpl 3 0 or later
gpl-3.0 | 3 | spdx gpl | spdx license identifier gpl 3 0( only)?
gpl-3.0-or-later | 2 | gpl | gpl {v}3( 0)? (or later|plus)
gpl-3.0-or-later | 2 | gplv3 | gplv3( 0)? (or later|plus)
gpl-3.0-or-later | 2 | gpl3 | gpl3( 0)? (or later|plus)
gpl-3.0 | 2 | gpl | (gnu )?gpl {v}3( 0)?( only)?
gpl-3.0 | 2 | gplv3 | (gnu )?gplv3
gpl-3.0 | 2 | gnu general | gnu general public license {v}3( 0)?
gpl-2.0-or-later | 3 | gnu general later | gnu general public license (\S+ ){0,16}either version 2 of the license or (at your option )?any later version
gpl-2.0-or-later | 3 | spdx gpl | spdx license identifier gpl 2 0 or later
gpl-2.0 | 3 | spdx gpl | spdx license identifier gpl 2 0( only)?
gpl-2.0-or-later | 2 | gpl later | gpl {v}2( 0)? or later
gpl-2.0 | 2 | gpl | (gnu )?gpl {v}2( 0)?( only)?
gpl-2.0 | 2 | gplv2 | (gnu )?gplv2
gpl-2.0 | 2 | gnu general | gnu general public license {v}2( 0)?
gpl-1.0 | 2 | gnu general | gnu general public license {v}1( 0)?
gpl-classpath-exception | 2 | classpath exception | (gpl )?(with )?(the )?classpath exception
gpl-gcc-exception | 2 | gcc exception | gcc runtime library exception
gpl-linking-exception | 2 | linking exception | linking exception
gpl-warranty | 3 | warranty gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl-copy | 3 | received copy gnu | you should have received a copy of the gnu general public license
gpl-redistribute | 3 | redistribute modify gnu | you can redistribute it and or modify it under the terms of the gnu general public license
gpl-any | 1 | gnu general | gnu general public licen[cs]e
gpl-any | 1 | gnu gpl | gnu gpl
lgpl-3.0-or-later | 3 | spdx lgpl | spdx license identifier lgpl 3 0 or later
lgpl-3.0 | 3 | spdx lgpl | spdx license identifier lgpl 3 0( only)?
lgpl-2.1-or-later | 3 | spdx lgpl | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | 3 | spdx lgpl | spdx license identifier lgpl 2 1( only)?
lgpl-2.0 | 3 | spdx lgpl | spdx license identifier lgpl 2 0( only)?
lgpl-3.0 | 2 | lesser general | (gnu )?lesser general public license {v}3( 0)?
lgpl-2.1 | 2 | lesser general | (gnu )?lesser general public license {v}2 1
lgpl-2.0 | 2 | library general | (gnu )?library general public license {v}2( 0)?
lgpl-3.0 | 2 | lgpl | lgpl {v}3( 0)?
lgpl-2.1 | 2 | lgpl | lgpl {v}2 1
lgpl-3.0 | 2 | lgplv3 | lgplv3
lgpl-2.1 | 2 | lgplv2 | lgplv2( 1)?
lgpl | 1 | lesser general | (gnu )?lesser general public licen[cs]e
lgpl | 1 | library general | (gnu )?library general public licen[cs]e
lgpl | 1 | gnu lgpl | gnu lgpl
agpl-3.0-or-later | 3 | spdx agpl | spdx license identifier agpl 3 0 or later
agpl-3.0 | 3 | spdx agpl | spdx license identifier agpl 3 0( only)?
agpl-3.0 | 2 | affero general | (gnu )?affero general public license {v}3( 0)?
agpl-1.0 | 2 | affero general | affero general public license {v}1( 0)?
agpl-3.0 | 2 | agpl | agpl {v}3( 0)?
agpl-3.0 | 2 | agplv3 | agplv3
agpl | 1 | affero general | (gnu )?affero general public licen[cs]e
sspl-1.0 | 2 | server side public | server side public license( {v}1)?
gfdl-1.3 | 2 | documentation gnu | gnu free documentation license {v}1 3
gfdl-1.2 | 2 | documentation gnu | gnu free documentation license {v}1 2
gfdl-1.1 | 2 | documentation gnu | gnu free documentation license {v}1 1
gfdl | 1 | documentation gnu | gnu free documentation licen[cs]e
gfdl | 1 | gfdl | gfdl
mpl-2.0 | 3 | mozilla source form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 3 | spdx mpl | spdx license identifier mpl 2 0
mpl-2.0 | 2 | mozilla public | mozilla public license {v}2( 0)?
mpl-1.1 | 2 | mozilla public | mozilla public license {v}1 1
mpl-1.0 | 2 | mozilla public | mozilla public license {v}1 0
mpl-2.0 | 2 | mpl | mpl {v}2( 0)?
mpl-1.1 | 2 | mpl | mpl {v}1 1
mpl | 1 | mozilla public | mozilla public licen[cs]e
npl-1.1 | 2 | netscape public | netscape public license( {v}1 1)?
epl-2.0 | 3 | spdx epl | spdx license identifier epl 2 0
epl-1.0 | 3 | spdx epl | spdx license identifier epl 1 0
epl-2.0 | 2 | eclipse public | eclipse public license {v}2( 0)?
epl-1.0 | 2 | eclipse public | eclipse public license {v}1( 0)?
epl | 1 | eclipse public | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse distribution | eclipse distribution license( {v}1 0)?
eupl-1.2 | 2 | european union public | european union public licen[cs]e {v}1 2
eupl-1.1 | 2 | european union public | european union public licen[cs]e {v}1 1
eupl | 1 | european union public | european union public licen[cs]e
eupl | 1 | eupl | eupl
cddl-1.1 | 2 | cddl | cddl {v}1 1
cddl-1.0 | 2 | cddl | cddl {v}1( 0)?
cddl-1.0 | 2 | common development distribution | common development and distribution license( {v}1 0)?
cpl-1.0 | 2 | common public | common public license( {v}1 0)?
ipl-1.0 | 2 | ibm public | ibm public license( {v}1 0)?
ms-pl | 2 | microsoft public | microsoft public licen[cs]e
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal licen[cs]e
artistic-2.0 | 2 | artistic | artistic license {v}2( 0)?
artistic-1.0 | 2 | artistic | artistic license {v}1( 0)?
artistic | 1 | artistic | (the )?artistic licen[cs]e
perl | 2 | perl same terms | (under )?the same terms as perl( itself)?
python-2.0 | 2 | python foundation | python software foundation license( version 2)?
psf | 1 | psf | psf licen[cs]e
ruby | 2 | ruby | ruby (s )?licen[cs]e
php-3.01 | 2 | php | php license( {v}3 01)?
zlib | 3 | altered plainly marked | altered source versions must be plainly marked as such
zlib | 3 | spdx zlib | spdx license identifier zlib
zlib | 2 | zlib | zlib( libpng)? licen[cs]e
libpng | 2 | libpng | (the )?libpng licen[cs]e
openssl | 2 | openssl | openssl licen[cs]e
openssl | 3 | openssl project | this product includes software developed by the openssl project
curl | 2 | curl | curl licen[cs]e
bsl-1.0 | 3 | spdx bsl | spdx license identifier bsl 1 0
bsl-1.0 | 2 | boost software | boost software license( {v}1 0)?
busl-1.1 | 2 | business source | business source license( 1 1)?
elastic-2.0 | 2 | elastic | elastic license( {v}2( 0)?)?
commons-clause | 2 | commons clause | commons clause( license condition)?
polyform-noncommercial | 2 | polyform noncommercial | polyform noncommercial license( 1 0 0)?
polyform-shield | 2 | polyform shield | polyform shield license( 1 0 0)?
prosperity | 2 | prosperity public | prosperity public license
unlicense | 3 | free unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | spdx unlicense | spdx license identifier unlicense
unlicense | 2 | unlicense | (the )?unlicense
wtfpl | 2 | wtfpl | wtfpl( {v}2)?
wtfpl | 2 | fuck public | do what the fuck you want to public license
public-domain | 2 | public domain | (released|placed|dedicated|put) (in|into|to) the public domain
public-domain | 2 | public domain | public domain dedication
public-domain | 1 | public domain | in the public domain
postgresql | 2 | postgresql | postgresql licen[cs]e
ncsa | 2 | ncsa | (university of illinois )?ncsa( open source)? licen[cs]e
afl-3.0 | 2 | academic free | academic free license( {v}3 0)?
osl-3.0 | 2 | open software license | open software license {v}3 0
osl | 1 | open software | open software licen[cs]e
qpl-1.0 | 2 | q public | q public license( {v}1 0)?
sleepycat | 2 | sleepycat | sleepycat( public)? licen[cs]e
vim | 2 | vim | vim licen[cs]e
w3c | 2 | w3c | w3c software( notice)?( and)?( document)? licen[cs]e
unicode | 2 | unicode | unicode (terms of use|license agreement|license v3)
icu | 2 | icu | icu licen[cs]e
ofl-1.1 | 3 | spdx ofl | spdx license identifier ofl 1 1
ofl-1.1 | 2 | sil open font | sil open font license( {v}1 1)?
ofl | 1 | open font | open font licen[cs]e
ijg | 2 | independent jpeg | independent jpeg group( s)?( license)?
ftl | 2 | freetype | freetype (project )?licen[cs]e
latex-1.3c | 2 | latex project public | latex project public license( {v}1 3c?)?
upl-1.0 | 2 | universal permissive | universal permissive license( {v}1 0)?
mulan-psl-2.0 | 2 | mulan | mulan permissive software licen[cs]e( {v}2)?
ecl-2.0 | 2 | educational community | educational community license( {v}2 0)?
cecill | 2 | cecill | cecill( (b|c|2 1))?( license)?
blueoak-1.0.0 | 2 | blue oak | blue oak model license( 1 0 0)?
cc0-1.0 | 3 | spdx cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 3 | waived copyright | has waived all copyright and related or neighboring rights
cc0-1.0 | 3 | creativecommons zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 2 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | 2 | creative commons zero | creative commons zero( 1 0)?
pddl-1.0 | 2 | pddl | pddl( 1 0)?
pddl-1.0 | 2 | public domain dedication | open data commons public domain dedication and license
odbl-1.0 | 2 | odbl | odbl( 1 0)?
odbl-1.0 | 2 | open database | (odc )?open database license( 1 0)?
odc-by-1.0 | 2 | odc | odc by( 1 0)?
cc-by-nc-nd-4.0 | 3 | licensed cc | licensed under cc by nc nd 4 0
cc-by-nc-sa-4.0 | 3 | licensed cc | licensed under cc by nc sa 4 0
cc-by-nc-4.0 | 3 | licensed cc | licensed under cc by nc 4 0
cc-by-nd-4.0 | 3 | licensed cc | licensed under cc by nd 4 0
cc-by-sa-4.0 | 3 | licensed cc | licensed under cc by sa 4 0
cc-by-4.0 | 3 | licensed cc | licensed under cc by 4 0
cc-by-nc-nd-4.0 | 3 | spdx cc | spdx license identifier cc by nc nd 4 0
cc-by-nc-sa-4.0 | 3 | spdx cc | spdx license identifier cc by nc sa 4 0
cc-by-nc-4.0 | 3 | spdx cc | spdx license identifier cc by nc 4 0
cc-by-sa-4.0 | 3 | spdx cc | spdx license identifier cc by sa 4 0
cc-by-4.0 | 3 | spdx cc | spdx license identifier cc by 4 0
cc-by-nc-nd-4.0 | 2 | cc nc nd | cc by nc nd 4 0( international)?
cc-by-nc-nd-3.0 | 2 | cc nc nd | cc by nc nd 3 0( unported)?
cc-by-nc-nd | 1 | cc nc nd | cc by nc nd
cc-by-nc-sa-4.0 | 2 | cc nc sa | cc by nc sa 4 0( international)?
cc-by-nc-sa-3.0 | 2 | cc nc sa | cc by nc sa 3 0( unported)?
cc-by-nc-sa | 1 | cc nc sa | cc by nc sa
cc-by-nc-4.0 | 2 | cc nc | cc by nc 4 0( international)?
cc-by-nc-3.0 | 2 | cc nc | cc by nc 3 0( unported)?
cc-by-nc-2.0 | 2 | cc nc | cc by nc 2 [05]
cc-by-nc | 1 | cc nc | cc by nc
cc-by-nd-4.0 | 2 | cc nd | cc by nd 4 0( international)?
cc-by-nd | 1 | cc nd | cc by nd
cc-by-sa-4.0 | 2 | cc sa | cc by sa 4 0( international)?
cc-by-sa-3.0 | 2 | cc sa | cc by sa 3 0( unported)?
cc-by-sa-2.0 | 2 | cc sa | cc by sa 2 [05]
cc-by-sa | 1 | cc sa | cc by sa
cc-by-4.0 | 2 | cc | cc by 4 0( international)?
cc-by-3.0 | 2 | cc | cc by 3 0( unported)?
cc-by-2.0 | 2 | cc | cc by 2 [05]
cc-by-nc-nd | 2 | creative commons attribution | creative commons attribution (noncommercial|non commercial) (noderivatives?|no derivatives?)( 4 0)?( international)?
cc-by-nc-sa | 2 | creative commons attribution | creative commons attribution (noncommercial|non commercial) (sharealike|share alike)( 4 0)?( international)?
cc-by-nc | 2 | creative commons attribution | creative commons attribution (noncommercial|non commercial)( 4 0)?( international)?
cc-by-nd | 2 | creative commons attribution | creative commons attribution (noderivatives?|no derivatives?)( 4 0)?( international)?
cc-by-sa | 2 | creative commons attribution | creative commons attribution (sharealike|share alike)( 4 0)?( international)?
cc-by-any | 1 | creative commons attribution | creative commons attribution( license)?( 4 0)?( international)?
creative-commons | 1 | creative commons | creative commons licen[cs]e
creative-commons | 1 | creativecommons | creativecommons org licenses
openrail | 2 | rail | (creativeml |bigscience )?(open )?rail (m )?licen[cs]e
openrail | 2 | openrail | (creativeml )?openrail( m)?( license)?
llama-community | 2 | llama community | llama ([0-9]+ ){0,2}community license( agreement)?
open-government-3.0 | 2 | open government | open government licen[cs]e( {v}3 0)?
proprietary | 3 | proprietary confidential | (proprietary and confidential|confidential and proprietary)
proprietary | 2 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 2 | prior written permission | (without|with) the( express)? prior written permission of
proprietary | 1 | proprietary | proprietary licen[cs]e
evaluation-only | 2 | evaluation purposes | for evaluation purposes only
no-redistribution | 2 | redistributed | may not be ((copied|published|broadcast|rewritten) ){1,4}or redistributed( without permission)?
noncommercial | 2 | noncommercial use | for noncommercial use only
noncommercial | 2 | commercial use | for non commercial use only
personal-use | 2 | personal use | for personal use only
research-only | 2 | research purposes | for research purposes only
copyright | 1 | copyright | copyright (c )?[12][0-9]{3}
copyright | 1 | copyright | copyright by \S+
epl-2.0 | 2 | epl | epl {v}2 0
epl-1.0 | 2 | epl | epl {v}1 0
eupl-1.2 | 2 | eupl | eupl {v}1 2
eupl-1.1 | 2 | eupl | eupl {v}1 1
bsl-1.0 | 2 | bsl | bsl {v}1 0
afl-3.0 | 2 | afl | afl {v}3 0
osl-3.0 | 2 | osl | osl {v}3 0
upl-1.0 | 2 | upl | upl {v}1 0
ecl-2.0 | 2 | ecl | ecl {v}2 0
artistic-2.0 | 2 | artistic | artistic {v}2 0
ofl-1.1 | 2 | ofl | ofl {v}1 1
sspl-1.0 | 2 | sspl | sspl( {v}1( 0)?)?
mit | 2 | mit licensed | mit licensed
mit | 2 | dual licensed mit | dual licensed( under)?( the)? mit
gpl-any | 2 | mit gpl | mit( and| or)? gpl
"""


def parsed() -> list[tuple[str, int, list[str], str, bool]]:
    """``(label, priority, keywords, pattern, is_base)`` in order, the base phrases first."""
    out = [(label, 1, sorted(phrase.split()), phrase, True) for label, phrase in BASE.items()]
    for line in RULES.strip().splitlines():
        label, priority, gates, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), gates.split(), pattern.replace("{v}", VERSION), False))
    for terms in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        for version in ("4 0", "3 0", "2 5", "2 0"):
            label = f"cc-{terms.replace(' ', '-')}-{version.replace(' ', '.')}"
            out.append((label, 3, ["creativecommons", *terms.split()], f"creativecommons org licenses {terms} {version}", False))
    return out
