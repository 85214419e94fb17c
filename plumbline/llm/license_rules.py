"""Signatures of licences, in order: earlier sections are stronger, and earlier lines win among equals.

A line is `keyword label pattern`. Patterns are regular expressions over a text's words, lower-cased and joined by
single spaces ("Version 2.0" reads "version 2 0"); they start and end at whole words. The keyword is a word that every
match holds: a text without it is never searched for the line.
"""

from __future__ import annotations

#: Sections with the confidence of a detection. BASE detections are never suppressed.
SECTIONS: list[tuple[str, float, str]] = [
    ("base", 0.5, r"""
cc cc-by cc by
general gpl general public license
reserved reserved all rights reserved
"""),
    ("tag", 1.0, r"""
spdx 0bsd spdx license identifier 0bsd
spdx afl-3.0 spdx license identifier afl 3 0
spdx agpl-3.0-or-later spdx license identifier agpl 3 0 (?:or later|plus)
spdx agpl-3.0 spdx license identifier agpl 3 0(?: only)?
spdx apache-1.1 spdx license identifier apache 1 1
spdx apache-2.0 spdx license identifier apache 2 0
spdx artistic-2.0 spdx license identifier artistic 2 0
spdx bsd-2-clause spdx license identifier bsd 2 clause
spdx bsd-3-clause spdx license identifier bsd 3 clause
spdx bsd-4-clause spdx license identifier bsd 4 clause
spdx bsl-1.0 spdx license identifier bsl 1 0
spdx busl-1.1 spdx license identifier busl 1 1
spdx cc0-1.0 spdx license identifier cc0 1 0
spdx cc-by-3.0 spdx license identifier cc by 3 0
spdx cc-by-4.0 spdx license identifier cc by 4 0
spdx cc-by-sa-3.0 spdx license identifier cc by sa 3 0
spdx cc-by-sa-4.0 spdx license identifier cc by sa 4 0
spdx cc-by-nc-4.0 spdx license identifier cc by nc 4 0
spdx cc-by-nd-4.0 spdx license identifier cc by nd 4 0
spdx cc-by-nc-sa-4.0 spdx license identifier cc by nc sa 4 0
spdx cc-by-nc-nd-4.0 spdx license identifier cc by nc nd 4 0
spdx cddl-1.0 spdx license identifier cddl 1 0
spdx cecill-2.1 spdx license identifier cecill 2 1
spdx ecl-2.0 spdx license identifier ecl 2 0
spdx epl-1.0 spdx license identifier epl 1 0
spdx epl-2.0 spdx license identifier epl 2 0
spdx eupl-1.2 spdx license identifier eupl 1 2
spdx gfdl-1.3 spdx license identifier gfdl 1 3(?: only| or later)?
spdx gpl-2.0-or-later spdx license identifier gpl 2 0 or later
spdx gpl-2.0 spdx license identifier gpl 2 0(?: only)?
spdx gpl-3.0-or-later spdx license identifier gpl 3 0 or later
spdx gpl-3.0 spdx license identifier gpl 3 0(?: only)?
spdx isc spdx license identifier isc
spdx lgpl-2.1-or-later spdx license identifier lgpl 2 1 or later
spdx lgpl-2.1 spdx license identifier lgpl 2 1(?: only)?
spdx lgpl-3.0-or-later spdx license identifier lgpl 3 0 or later
spdx lgpl-3.0 spdx license identifier lgpl 3 0(?: only)?
spdx mit-0 spdx license identifier mit 0
spdx mit spdx license identifier mit
spdx mpl-1.1 spdx license identifier mpl 1 1
spdx mpl-2.0 spdx license identifier mpl 2 0
spdx ms-pl spdx license identifier ms pl
spdx ncsa spdx license identifier ncsa
spdx odbl-1.0 spdx license identifier odbl 1 0
spdx ofl-1.1 spdx license identifier ofl 1 1
spdx osl-3.0 spdx license identifier osl 3 0
spdx postgresql spdx license identifier postgresql
spdx python-2.0 spdx license identifier (?:python 2 0|psf 2 0)
spdx unlicense spdx license identifier unlicense
spdx upl-1.0 spdx license identifier upl 1 0
spdx wtfpl spdx license identifier wtfpl
spdx zlib spdx license identifier zlib
spdx zpl-2.1 spdx license identifier zpl 2 1
"""),
    ("link", 0.95, r"""
apache apache-2.0 apache org licenses license 2 0(?: txt| html)?
apache apache-1.1 apache org licenses license 1 1(?: txt)?
gnu agpl-3.0 gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gnu lgpl-2.1 gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
gnu lgpl-3.0 gnu org licenses lgpl(?: 3 0)?(?: html| txt)?
gnu gpl-2.0 gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gnu gpl-3.0 gnu org licenses gpl(?: 3 0)?(?: html| txt)?
gnu gfdl-1.3 gnu org licenses fdl(?: 1 3)?(?: html| txt)?
creativecommons cc-by-4.0 creativecommons org licenses by 4 0(?: legalcode)?
creativecommons cc-by-3.0 creativecommons org licenses by 3 0(?: legalcode)?
creativecommons cc-by-2.0 creativecommons org licenses by 2 0(?: legalcode)?
creativecommons cc-by-sa-4.0 creativecommons org licenses by sa 4 0(?: legalcode)?
creativecommons cc-by-sa-3.0 creativecommons org licenses by sa 3 0(?: legalcode)?
creativecommons cc-by-nd-4.0 creativecommons org licenses by nd 4 0(?: legalcode)?
creativecommons cc-by-nc-4.0 creativecommons org licenses by nc 4 0(?: legalcode)?
creativecommons cc-by-nc-3.0 creativecommons org licenses by nc 3 0(?: legalcode)?
creativecommons cc-by-nc-sa-4.0 creativecommons org licenses by nc sa 4 0(?: legalcode)?
creativecommons cc-by-nc-sa-3.0 creativecommons org licenses by nc sa 3 0(?: legalcode)?
creativecommons cc-by-nc-nd-4.0 creativecommons org licenses by nc nd 4 0(?: legalcode)?
creativecommons cc0-1.0 creativecommons org publicdomain zero 1 0(?: legalcode)?
creativecommons public-domain creativecommons org publicdomain mark 1 0
mozilla mpl-2.0 mozilla org (?:en us )?mpl 2 0
mozilla mpl-1.1 mozilla org (?:en us )?mpl (?:mpl )?1 1(?: html)?
eclipse epl-1.0 eclipse org legal epl v10(?: html)?
eclipse epl-2.0 eclipse org legal epl (?:2 0|v20)(?: html)?
opensource mit opensource org licenses mit(?: license)?(?: php)?
opensource bsd-3-clause opensource org licenses bsd (?:3 clause|license)(?: php)?
opensource bsd-2-clause opensource org licenses bsd 2 clause
opensource isc opensource org licenses isc(?: license)?(?: txt)?
opensource zlib opensource org licenses zlib(?: license)?(?: php)?
boost bsl-1.0 boost org license 1 0(?: txt)?
unlicense unlicense unlicense org
wtfpl wtfpl wtfpl net(?: txt copying)?
scripts ofl-1.1 scripts sil org ofl
opendatacommons odbl-1.0 opendatacommons org licenses odbl(?: 1 0)?
opendatacommons odc-by-1.0 opendatacommons org licenses by(?: 1 0)?
opendatacommons pddl-1.0 opendatacommons org licenses pddl(?: 1 0)?
"""),
    ("text", 0.95, r"""
hereby mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
substantial mit the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
modify isc permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
redistributions bsd-2-clause redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
neither bsd-3-clause neither the name of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote products
advertising bsd-4-clause all advertising materials mentioning features or use of this software must display
altered zlib altered source versions must be plainly marked as such and must not be misrepresented
unencumbered unlicense this is free and unencumbered software released into the public domain
fuck wtfpl do what the fuck you want to public license
compliance apache-2.0 you may not use this file except in compliance with the license
conveyed gpl-3.0 this program is free software (?:\S+ ){0,30}?conveyed under the terms of this license
redistribute gpl-2.0-or-later you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)?(?: or at your option any later version)
redistribute gpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)?(?: or at your option any later version)
redistribute lgpl-2.1-or-later you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)?(?: or at your option any later version)
redistribute lgpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)?(?: or at your option any later version)
redistribute agpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)?(?: or at your option any later version)
mozilla mpl-2.0 this source code form is subject to the terms of the mozilla public license v 2 0
mozilla mpl-1.1 the contents of this file are subject to the mozilla public license version 1 1
eclipse epl-2.0 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?2 0
eclipse epl-1.0 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?1 0
development cddl-1.0 the contents of this file are subject to the terms of the common development and distribution license
boost bsl-1.0 distributed under the boost software license version 1 0
font ofl-1.1 this font software is licensed under the sil open font license version 1 1
waived cc0-1.0 to the extent possible under law (?:\S+ ){1,12}?has waived all copyright and related or neighboring rights
"""),
    ("name", 0.9, r"""
apache apache-2.0 apache (?:software )?license (?:v ?|version )?2(?: 0)?
apache apache-1.1 apache (?:software )?license (?:v ?|version )?1 1
apache apache-1.0 apache (?:software )?license (?:v ?|version )?1 0
affero agpl-3.0-or-later (?:gnu )?affero general public license (?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?
affero agpl-3.0 (?:gnu )?affero general public license (?:v ?|version )?3(?: 0)?
affero agpl-1.0 affero general public license (?:v ?|version )?1(?: 0)?
lesser lgpl-2.1-or-later (?:gnu )?lesser general public license (?:v ?|version )?2 1 or (?:any )?later(?: version)?
lesser lgpl-3.0-or-later (?:gnu )?lesser general public license (?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?
lesser lgpl-2.1 (?:gnu )?lesser general public license (?:v ?|version )?2 1
lesser lgpl-3.0 (?:gnu )?lesser general public license (?:v ?|version )?3(?: 0)?
library lgpl-2.0 (?:gnu )?library general public license (?:v ?|version )?2(?: 0)?
general gpl-2.0-or-later (?:gnu )?general public license (?:v ?|version )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
general gpl-3.0-or-later (?:gnu )?general public license (?:v ?|version )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
general gpl-1.0 (?:gnu )?general public license (?:v ?|version )?1(?: 0)?
general gpl-2.0 (?:gnu )?general public license (?:v ?|version )?2(?: 0)?
general gpl-3.0 (?:gnu )?general public license (?:v ?|version )?3(?: 0)?
documentation gfdl-1.3 (?:gnu )?free documentation license (?:v ?|version )?1 3
documentation gfdl-1.2 (?:gnu )?free documentation license (?:v ?|version )?1 2
documentation gfdl-1.1 (?:gnu )?free documentation license (?:v ?|version )?1 1
mozilla mpl-1.0 mozilla public license (?:v ?|version )?1 0
mozilla mpl-1.1 mozilla public license (?:v ?|version )?1 1
mozilla mpl-2.0 mozilla public license (?:v ?|version )?2(?: 0)?
eclipse epl-1.0 eclipse public license (?:v ?|version )?1 0
eclipse epl-2.0 eclipse public license (?:v ?|version )?2 0
eclipse edl-1.0 eclipse distribution license (?:v ?|version )?1 0
european eupl-1.1 european union public licen[cs]e (?:v ?|version )?1 1
european eupl-1.2 european union public licen[cs]e (?:v ?|version )?1 2
boost bsl-1.0 boost software license (?:v ?|version )?1 0
business busl-1.1 business source license (?:v ?|version )?1 1
artistic artistic-1.0 artistic license (?:v ?|version )?1 0
artistic artistic-2.0 artistic license (?:v ?|version )?2 0
academic afl-3.0 academic free license (?:v ?|version )?3 0
open osl-3.0 open software license (?:v ?|version )?3 0
open ofl-1.1 open font license (?:v ?|version )?1 1
open odbl-1.0 open (?:data commons open )?database license(?: odbl)?(?: v 1 0| 1 0| version 1 0)?
open ogl-3.0 open government licen[cs]e (?:v ?|version )?(?:3 0|v3)
educational ecl-2.0 educational community license (?:v ?|version )?2 0
development cddl-1.0 common development and distribution license (?:cddl )?(?:v ?|version )?1 0
development cddl-1.1 common development and distribution license (?:cddl )?(?:v ?|version )?1 1
universal upl-1.0 universal permissive license (?:v ?|version )?1 0
server sspl-1.0 server side public license (?:v ?|version )?1
elastic elastic-2.0 elastic license (?:v ?|version )?(?:2 0|v2)
zope zpl-2.1 zope public license (?:v ?|version )?2 1
python python-2.0 python software foundation license(?: version 2)?
cecill cecill-2.1 cecill (?:free software license agreement )?(?:v ?|version )?2 1
bsd bsd-2-clause (?:2|two) clause bsd(?: license)?
bsd bsd-2-clause bsd (?:2|two) clause(?: license)?
bsd bsd-3-clause (?:3|three) clause bsd(?: license)?
bsd bsd-3-clause bsd (?:3|three) clause(?: license)?
bsd bsd-4-clause (?:4|four) clause bsd(?: license)?
bsd bsd-4-clause bsd (?:4|four) clause(?: license)?
bsd bsd-3-clause (?:new|modified|revised) bsd license
bsd bsd-2-clause simplified bsd license
bsd bsd-4-clause original bsd license
zero 0bsd (?:zero clause bsd|bsd zero clause)(?: license)?
commons cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: license)? 4 0(?: international)?
commons cc-by-nc-nd-3.0 creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: license)? 3 0(?: unported)?
commons cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike(?: license)? 4 0(?: international)?
commons cc-by-nc-sa-3.0 creative commons attribution non ?commercial share ?alike(?: license)? 3 0(?: unported)?
commons cc-by-nc-4.0 creative commons attribution non ?commercial(?: license)? 4 0(?: international)?
commons cc-by-nc-3.0 creative commons attribution non ?commercial(?: license)? 3 0(?: unported)?
commons cc-by-nd-4.0 creative commons attribution no ?deriv(?:ative)?s(?: license)? 4 0(?: international)?
commons cc-by-sa-4.0 creative commons attribution share ?alike(?: license)? 4 0(?: international)?
commons cc-by-sa-3.0 creative commons attribution share ?alike(?: license)? 3 0(?: unported)?
commons cc-by-sa-2.0 creative commons attribution share ?alike(?: license)? 2 0(?: generic)?
commons cc-by-4.0 creative commons attribution(?: license)? 4 0(?: international)?
commons cc-by-3.0 creative commons attribution(?: license)? 3 0(?: unported)?
commons cc-by-2.0 creative commons attribution(?: license)? 2 0(?: generic)?
universal cc0-1.0 (?:creative commons )?(?:cc0|zero)(?: 1 0)? universal(?: 1 0)?(?: public domain dedication)?
cc0 cc0-1.0 cc0 1 0(?: universal)?
"""),
    ("short", 0.8, r"""
cc cc-by-nc-nd-4.0 cc by nc nd 4 0
cc cc-by-nc-nd-3.0 cc by nc nd 3 0
cc cc-by-nc-sa-4.0 cc by nc sa 4 0
cc cc-by-nc-sa-3.0 cc by nc sa 3 0
cc cc-by-nc-4.0 cc by nc 4 0
cc cc-by-nc-3.0 cc by nc 3 0
cc cc-by-nd-4.0 cc by nd 4 0
cc cc-by-nd-3.0 cc by nd 3 0
cc cc-by-sa-4.0 cc by sa 4 0
cc cc-by-sa-3.0 cc by sa 3 0
cc cc-by-sa-2.5 cc by sa 2 5
cc cc-by-4.0 cc by 4 0
cc cc-by-3.0 cc by 3 0
cc cc-by-2.5 cc by 2 5
cc cc-by-2.0 cc by 2 0
gplv2 gpl-2.0 (?:gnu )?gplv2
gplv3 gpl-3.0 (?:gnu )?gplv3
gpl gpl-2.0-or-later gpl (?:v ?|version )?2(?: 0)? or later
gpl gpl-3.0-or-later gpl (?:v ?|version )?3(?: 0)? or later
gpl gpl-2.0 gpl (?:v ?|version )?2(?: 0)?(?: only)?
gpl gpl-3.0 gpl (?:v ?|version )?3(?: 0)?(?: only)?
lgplv2 lgpl-2.1 (?:gnu )?lgplv2(?: 1)?
lgplv3 lgpl-3.0 (?:gnu )?lgplv3
lgpl lgpl-2.1 lgpl (?:v ?|version )?2 1
lgpl lgpl-3.0 lgpl (?:v ?|version )?3(?: 0)?
agplv3 agpl-3.0 (?:gnu )?agplv3
agpl agpl-3.0 agpl (?:v ?|version )?3(?: 0)?
mpl mpl-1.1 mpl (?:v ?|version )?1 1
mpl mpl-2.0 mpl (?:v ?|version )?2 0
epl epl-1.0 epl (?:v ?|version )?1 0
epl epl-2.0 epl (?:v ?|version )?2 0
cddl cddl-1.0 cddl (?:v ?|version )?1 0
eupl eupl-1.2 eupl (?:v ?|version )?1 2
asl apache-2.0 asl (?:v ?|version )?2 0
odbl odbl-1.0 odbl (?:v ?|version )?1 0
ofl ofl-1.1 (?:sil )?ofl (?:v ?|version )?1 1
"""),
    ("family", 0.7, r"""
mit mit (?:the )?mit licen[cs]e
mit mit licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit
expat mit expat licen[cs]e
x11 x11 x11 licen[cs]e
isc isc isc licen[cs]e
zlib zlib zlib(?: libpng)? licen[cs]e
bsd bsd bsd(?: style)? licen[cs]e
bsd bsd licen[cs]ed under (?:the )?bsd
apache apache apache (?:software )?licen[cs]e
affero agpl (?:gnu )?affero general public licen[cs]e
lesser lgpl (?:gnu )?lesser general public licen[cs]e
library lgpl (?:gnu )?library general public licen[cs]e
general gpl gnu general public licen[cs]e
gpl gpl (?:gnu gpl|gpl licen[cs]ed?|under the gpl)
lgpl lgpl (?:gnu lgpl|lgpl licen[cs]ed?|under the lgpl)
agpl agpl (?:gnu agpl|agpl licen[cs]ed?|under the agpl)
documentation gfdl (?:gnu )?free documentation licen[cs]e
mozilla mpl mozilla public licen[cs]e
eclipse epl eclipse public licen[cs]e
european eupl european union public licen[cs]e
artistic artistic artistic licen[cs]e
perl artistic same terms as perl(?: itself)?
boost bsl-1.0 boost software licen[cs]e
python python python(?: software foundation)? licen[cs]e
ruby ruby ruby licen[cs]e
php php-3.01 php licen[cs]e(?: 3 01)?
postgresql postgresql postgresql licen[cs]e
openssl openssl openssl licen[cs]e
w3c w3c w3c (?:software )?(?:notice and )?licen[cs]e
unicode unicode unicode (?:inc )?licen[cs]e(?: agreement)?
ncsa ncsa (?:university of illinois )?ncsa open source licen[cs]e
microsoft ms-pl microsoft public licen[cs]e
microsoft ms-rl microsoft reciprocal licen[cs]e
common cpl-1.0 common public licen[cs]e(?: 1 0| version 1 0)?
ibm ipl-1.0 ibm public licen[cs]e
qt qpl-1.0 (?:trolltech )?qt public licen[cs]e
vim vim vim licen[cs]e
beerware beerware (?:the )?beerware licen[cs]e
beer beerware (?:the )?beer ware licen[cs]e
wtfpl wtfpl wtfpl
unlicense unlicense the unlicense
commons cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s
commons cc-by-nc-sa creative commons attribution non ?commercial share ?alike
commons cc-by-nc creative commons attribution non ?commercial
commons cc-by-nd creative commons attribution no ?deriv(?:ative)?s
commons cc-by-sa creative commons attribution share ?alike
commons cc-by creative commons attribution
cc cc-by-nc-nd cc by nc nd
cc cc-by-nc-sa cc by nc sa
cc cc-by-nc cc by nc
cc cc-by-nd cc by nd
cc cc-by-sa cc by sa
cc0 cc0-1.0 cc0
commons creative-commons creative commons(?: licen[cs]e)?
government ogl open government licen[cs]e
openrail openrail (?:creativeml )?openrail(?: m)?(?: licen[cs]e)?
llama llama llama (?:2|3|3 1|3 2) community licen[cs]e(?: agreement)?
"""),
    ("mention", 0.4, r"""
domain public-domain (?:released into|placed in|in) the public domain
proprietary proprietary (?:proprietary and confidential|confidential and proprietary)
commercial non-commercial (?:for )?non commercial use only
noncommercial non-commercial (?:for )?noncommercial use only
commercial commercial commercial licen[cs]e
reproduced permission-needed (?:may not be|no part of (?:\S+ ){1,6}?may be) reproduced(?: \S+){0,8}? without (?:\S+ ){0,4}?permission
permission permission-needed (?:used|reprinted|reproduced) (?:by|with)(?: \S+)? permission
royalty royalty-free royalty free(?: licen[cs]e)?
copyleft copyleft copyleft
trademark trademark registered trademarks? of
copyright copyright copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
"""),
]
