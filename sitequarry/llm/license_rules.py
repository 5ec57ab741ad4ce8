"""The ordered signature rules of the licence scan.

One rule a line: label, priority (higher wins), keyword that must occur for the rule to be tried, pattern. Texts are matched
as lower-case words joined by single spaces ("CC BY-NC 4.0" is "cc by nc 4 0"). Priorities: 90 notices that name licence and
version, 80 licence and version, 70 identifiers, 60 a licence's own sentences, 50 a licence without its version, 30 families,
20 statements of rights.
"""

from __future__ import annotations

RULES = r"""
apache-2.0|90|apache|licensed under the apache license version 2( 0)?( the license)?
apache-2.0|80|apache|apache (software )?licen[cs]e (version |v )?2( 0)?
apache-2.0|80|apache|apache licen[cs]e v2( 0)?
apache-2.0|70|apache|(spdx license identifier|license|licence) apache 2 0
apache-2.0|60|apache|www apache org licenses license 2 0
apache-2.0|60|compliance|you may not use this file except in compliance with the license
apache-1.1|80|apache|apache (software )?licen[cs]e (version )?1 1
apache-1.0|80|apache|apache (software )?licen[cs]e (version )?1 0
apache|50|apache|(licensed|released|distributed|available) under the apache licen[cs]e
apache|30|apache|apache (software )?licen[cs]e
mit|90|mit|(released|licensed|distributed|available|published) under (the )?(terms of (the )?)?mit licen[cs]e
mit|80|mit|the mit licen[cs]e( mit)?
mit|70|mit|(spdx license identifier|license|licence) mit
mit|60|hereby|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|60|mit|opensource org licenses mit( license)?
mit|50|mit|mit (x11 |expat )?licen[cs]e
mit|50|expat|expat licen[cs]e
mit-0|80|mit|mit (no attribution|0)( licen[cs]e)?
x11|80|x11|x11 licen[cs]e
bsd-2-clause|90|bsd|(released|licensed|distributed) under (the )?(terms of the )?(simplified|2 clause|two clause) bsd licen[cs]e
bsd-2-clause|80|licen|(simplified|2 clause|two clause|freebsd) (bsd )?licen[cs]e
bsd-2-clause|70|bsd|bsd 2 clause( licen[cs]e)?
bsd-3-clause|90|bsd|(released|licensed|distributed) under (the )?(terms of the )?(new|revised|modified|3 clause|three clause) bsd licen[cs]e
bsd-3-clause|80|bsd|(new|revised|modified|3 clause|three clause) bsd licen[cs]e
bsd-3-clause|70|bsd|bsd 3 clause( licen[cs]e)?
bsd-3-clause|60|neither|neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-4-clause|80|bsd|(original|4 clause|four clause) bsd licen[cs]e
bsd-4-clause|70|bsd|bsd 4 clause( licen[cs]e)?
bsd-4-clause|60|advertising|all advertising materials mentioning features or use of this software must display
bsd|60|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|50|bsd|(released|licensed|distributed) under (the |a )?bsd( style)? licen[cs]e
bsd|30|bsd|bsd( style)? licen[cs]e
0bsd|80|bsd|(zero clause bsd|0bsd|bsd zero clause)( licen[cs]e)?
isc|80|isc|(the )?isc licen[cs]e
isc|70|isc|(spdx license identifier|license|licence) isc
isc|60|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
gpl-3.0|90|gnu|licensed under the gnu general public licen[cs]e (version |v )?3( 0)?
gpl-3.0|80|gnu|gnu general public licen[cs]e (version |v )3( 0)?
gpl-3.0|80|general|general public licen[cs]e (version |v )3( 0)?
gpl-3.0|70|gpl|(gnu )?gpl ?(version |v )?3( 0)?( only)?
gpl-3.0|70|gplv3|gplv3( 0)?
gpl-3.0-or-later|90|gnu|gnu general public licen[cs]e .{0,60}?version 3( 0)? (of the license )?or (at your option )?any later version
gpl-3.0-or-later|75|gpl|gpl 3 0 or later
gpl-3.0-or-later|75|gpl|(gnu )?gplv?3 or (any )?later
gpl-2.0|90|gnu|licensed under the gnu general public licen[cs]e (version |v )?2( 0)?
gpl-2.0|80|gnu|gnu general public licen[cs]e (version |v )2( 0)?
gpl-2.0|80|general|general public licen[cs]e (version |v )2( 0)?
gpl-2.0|70|gpl|(gnu )?gpl ?(version |v )?2( 0)?( only)?
gpl-2.0|70|gplv2|gplv2( 0)?
gpl-2.0-or-later|90|gnu|gnu general public licen[cs]e .{0,60}?version 2( 0)? (of the license )?or (at your option )?any later version
gpl-2.0-or-later|75|gpl|gpl 2 0 or later
gpl-2.0-or-later|75|gpl|(gnu )?gplv?2 or (any )?later
gpl-1.0|80|general|general public licen[cs]e (version |v )1( 0)?
gpl|60|redistribute|you can redistribute it and or modify it under the terms of the gnu general public license
gpl|50|gnu|gnu general public licen[cs]e
gpl|50|gnu|gnu gpl
gpl|30|general|general public licen[cs]e
gpl|30|gpl|gpl (licen[cs]e|licen[cs]ed|compatible)
lgpl-3.0|85|lesser|(gnu )?lesser general public licen[cs]e (version |v )?3( 0)?
lgpl-3.0|75|lgpl|lgpl ?(version |v )?3( 0)?
lgpl-3.0|75|lgplv3|lgplv3
lgpl-2.1|85|lesser|(gnu )?lesser general public licen[cs]e (version |v )?2 1
lgpl-2.1|75|lgpl|lgpl ?(version |v )?2 1
lgpl-2.1|75|lgplv2|lgplv2 1
lgpl-2.0|85|library|(gnu )?library general public licen[cs]e( version 2( 0)?)?
lgpl|55|lesser|(gnu )?lesser general public licen[cs]e
lgpl|40|lgpl|(gnu )?lgpl
agpl-3.0|85|affero|(gnu )?affero general public licen[cs]e (version |v )?3( 0)?
agpl-3.0|75|agpl|agpl ?(version |v )?3( 0)?
agpl-3.0|75|agplv3|agplv3
agpl|55|affero|(gnu )?affero (general public )?licen[cs]e
agpl|40|agpl|(gnu )?agpl
gfdl-1.3|85|documentation|gnu free documentation licen[cs]e (version )?1 3
gfdl-1.2|85|documentation|gnu free documentation licen[cs]e (version )?1 2
gfdl-1.1|85|documentation|gnu free documentation licen[cs]e (version )?1 1
gfdl|55|documentation|gnu free documentation licen[cs]e
gfdl|40|gfdl|gfdl
mpl-2.0|90|mozilla|subject to the terms of the mozilla public licen[cs]e v(ersion)? ?2 0
mpl-2.0|80|mozilla|mozilla public licen[cs]e (version |v ?)?2( 0)?
mpl-2.0|70|mpl|mpl (version |v )?2 0
mpl-1.1|80|mozilla|mozilla public licen[cs]e (version |v ?)?1 1
mpl-1.1|70|mpl|mpl (version |v )?1 1
mpl-1.0|80|mozilla|mozilla public licen[cs]e (version |v ?)?1 0
mpl|50|mozilla|mozilla public licen[cs]e
epl-2.0|80|eclipse|eclipse public licen[cs]e (version |v ?)?2( 0)?
epl-2.0|70|epl|epl (version |v )?2 0
epl-1.0|80|eclipse|eclipse public licen[cs]e (version |v ?)?1( 0)?
epl-1.0|70|epl|epl (version |v )?1 0
epl|50|eclipse|eclipse public licen[cs]e
edl-1.0|80|eclipse|eclipse distribution licen[cs]e( v?1 0)?
cddl-1.1|80|cddl|cddl (version )?1 1
cddl-1.0|80|cddl|cddl (version )?1 0
cddl-1.1|85|distribution|common development and distribution licen[cs]e (version )?1 1
cddl-1.0|85|distribution|common development and distribution licen[cs]e (version )?1 0
cddl|50|distribution|common development and distribution licen[cs]e
cpl-1.0|80|common|common public licen[cs]e( version| v)?( 1 0)?
cpal-1.0|80|attribution|common public attribution licen[cs]e( version)?( 1 0)?
eupl-1.2|80|eupl|eupl (version |v )?1 2
eupl-1.1|80|eupl|eupl (version |v )?1 1
eupl|50|european|european union public licen[cs]e
artistic-2.0|80|artistic|artistic licen[cs]e (version )?2( 0)?
artistic-1.0|80|artistic|artistic licen[cs]e (version )?1( 0)?
artistic|50|artistic|artistic licen[cs]e
zlib|80|zlib|zlib( libpng)? licen[cs]e
zlib|60|altered|altered source versions must be plainly marked as such
libpng|80|libpng|libpng licen[cs]e
boost-1.0|80|boost|boost software licen[cs]e (version )?1( 0)?
boost|50|boost|boost software licen[cs]e
boost-1.0|70|bsl|bsl 1 0
wtfpl|80|wtfpl|wtfpl( version)?( 2)?
wtfpl|80|fuck|do what the fuck you want to public licen[cs]e
unlicense|80|unlicense|(the )?unlicense
unlicense|60|unencumbered|this is free and unencumbered software released into the public domain
beerware|80|beer|beer ?ware licen[cs]e
postgresql|80|postgresql|postgresql licen[cs]e
python-2.0|80|python|python software foundation licen[cs]e( version)?( 2)?
python-2.0|70|psf|psf licen[cs]e
php-3.01|80|php|php licen[cs]e (version )?3 01
php|50|php|php licen[cs]e
ruby|80|ruby|ruby licen[cs]e
openssl|80|openssl|openssl licen[cs]e
ssleay|80|ssleay|(original )?ssleay licen[cs]e
curl|80|curl|curl licen[cs]e
ncsa|80|ncsa|(university of illinois )?ncsa( open source)? licen[cs]e
ncsa|80|illinois|university of illinois open source licen[cs]e
w3c|80|w3c|w3c software( notice)?( and)? licen[cs]e
ofl-1.1|80|sil|sil open font licen[cs]e( version| v)?( 1 1)?
ofl-1.1|70|ofl|ofl 1 1
ofl|50|font|open font licen[cs]e
ms-pl|80|microsoft|microsoft public licen[cs]e
ms-rl|80|microsoft|microsoft reciprocal licen[cs]e
upl-1.0|80|permissive|universal permissive licen[cs]e( version| v)?( 1 0)?
afl-3.0|80|academic|academic free licen[cs]e( version| v)?( 3 0)?
osl-3.0|80|open|open software licen[cs]e( version| v)?( 3 0)?
ecl-2.0|80|educational|educational community licen[cs]e( version)?( 2 0)?
qpl-1.0|80|q public|q public licen[cs]e( version)?( 1 0)?
sleepycat|80|sleepycat|sleepycat licen[cs]e
vim|80|vim|vim licen[cs]e
lppl-1.3c|80|latex|latex project public licen[cs]e( version)?( 1 3c?)?
ipl-1.0|80|ibm|ibm public licen[cs]e( version| v)?( 1 0)?
npl-1.1|80|netscape|netscape public licen[cs]e( version)?( 1 [01])?
spl-1.0|80|sun|sun public licen[cs]e( version| v)?( 1 0)?
apsl-2.0|80|apple|apple public source licen[cs]e( version)?( 2 0)?
rpl-1.5|80|reciprocal|reciprocal public licen[cs]e( version)?( 1 5)?
intel|80|intel|intel open source licen[cs]e
cecill-2.1|80|cecill|cecill( free software licen[cs]e)?( agreement)?( version| v)? 2 1
cecill-b|80|cecill|cecill b( licen[cs]e)?
cecill-c|80|cecill|cecill c( licen[cs]e)?
cecill|50|cecill|cecill( licen[cs]e)?
blueoak-1.0.0|80|blue oak|blue oak model licen[cs]e( 1 0 0)?
mulan-psl-2.0|80|mulan|mulan (psl|permissive software licen[cs]e)( version| v)?2?
sspl-1.0|80|server|server side public licen[cs]e( version| v)?( 1)?
sspl-1.0|70|sspl|sspl( v)?( ?1)?( 0)?
busl-1.1|80|business|business source licen[cs]e( version)?( 1 1)?
elastic-2.0|80|elastic|elastic licen[cs]e (version |v )?2( 0)?
elastic|50|elastic|elastic licen[cs]e
commons-clause|80|commons|commons clause( licen[cs]e condition)?( v1 0)?
polyform-noncommercial|80|polyform|polyform noncommercial licen[cs]e( 1 0 0)?
polyform|50|polyform|polyform [a-z]+ licen[cs]e
openrail|80|rail|(bigscience |creativeml )?open ?rail( m)?( licen[cs]e)?
llama|80|llama|llama [0-9 ]*community licen[cs]e( agreement)?
odbl-1.0|80|database|open (data commons open )?database licen[cs]e( version| v)?( 1 0)?
odbl-1.0|70|odbl|odbl( 1 0)?
odc-by-1.0|80|commons|open data commons attribution licen[cs]e( v1 0)?
odc-by-1.0|70|odc|odc by( 1 0)?
pddl-1.0|80|dedication|open data commons public domain dedication( and licen[cs]e)?
pddl-1.0|70|pddl|pddl( 1 0)?
cdla-permissive|80|cdla|cdla permissive( v?[12] 0)?
cdla-permissive|80|community|community data licen[cs]e agreement permissive( version)?( [12] 0)?
cdla-sharing|80|cdla|cdla sharing( v?1 0)?
cdla-sharing|80|community|community data licen[cs]e agreement sharing( version)?( 1 0)?
ogl-uk-3.0|80|government|open government licen[cs]e( v| version)? ?3( 0)?
ogl|50|government|open government licen[cs]e
etalab-2.0|80|etalab|etalab (open )?licen[cs]e( v)?( ?2 0)?
etalab|70|licence ouverte|licence ouverte( open licence)?( v)?( ?2 0)?
dl-de-by-2.0|80|datenlizenz|datenlizenz deutschland namensnennung( version)?( 2 0)?
dl-de-zero-2.0|80|datenlizenz|datenlizenz deutschland zero( version)?( 2 0)?
cc0-1.0|85|cc0|(licensed under |released under )?cc0( 1 0)?( universal)?( licen[cs]e)?
cc0-1.0|85|creative|creative commons (cc )?zero( v?1 0)?( universal)?
cc0-1.0|70|publicdomain|creativecommons org publicdomain zero 1 0
cc-by-nc-nd-4.0|95|cc by|(licensed under )?cc by nc nd 4 0
cc-by-nc-nd-3.0|95|cc by|(licensed under )?cc by nc nd 3 0
cc-by-nc-nd-2.5|95|cc by|(licensed under )?cc by nc nd 2 5
cc-by-nc-nd-2.0|95|cc by|(licensed under )?cc by nc nd 2 0
cc-by-nc-nd|80|cc by|(licensed under )?cc by nc nd
cc-by-nc-sa-4.0|95|cc by|(licensed under )?cc by nc sa 4 0
cc-by-nc-sa-3.0|95|cc by|(licensed under )?cc by nc sa 3 0
cc-by-nc-sa-2.5|95|cc by|(licensed under )?cc by nc sa 2 5
cc-by-nc-sa-2.0|95|cc by|(licensed under )?cc by nc sa 2 0
cc-by-nc-sa|80|cc by|(licensed under )?cc by nc sa
cc-by-nc-4.0|90|cc by|(licensed under )?cc by nc 4 0
cc-by-nc-3.0|90|cc by|(licensed under )?cc by nc 3 0
cc-by-nc-2.5|90|cc by|(licensed under )?cc by nc 2 5
cc-by-nc-2.0|90|cc by|(licensed under )?cc by nc 2 0
cc-by-nc|75|cc by|(licensed under )?cc by nc
cc-by-nd-4.0|90|cc by|(licensed under )?cc by nd 4 0
cc-by-nd-3.0|90|cc by|(licensed under )?cc by nd 3 0
cc-by-nd-2.5|90|cc by|(licensed under )?cc by nd 2 5
cc-by-nd-2.0|90|cc by|(licensed under )?cc by nd 2 0
cc-by-nd|75|cc by|(licensed under )?cc by nd
cc-by-sa-4.0|90|cc by|(licensed under )?cc by sa 4 0
cc-by-sa-3.0|90|cc by|(licensed under )?cc by sa 3 0
cc-by-sa-2.5|90|cc by|(licensed under )?cc by sa 2 5
cc-by-sa-2.0|90|cc by|(licensed under )?cc by sa 2 0
cc-by-sa-1.0|90|cc by|(licensed under )?cc by sa 1 0
cc-by-sa|75|cc by|(licensed under )?cc by sa
cc-by-4.0|85|cc by|(licensed under )?cc by 4 0
cc-by-3.0|85|cc by|(licensed under )?cc by 3 0
cc-by-2.5|85|cc by|(licensed under )?cc by 2 5
cc-by-2.0|85|cc by|(licensed under )?cc by 2 0
cc-by-1.0|85|cc by|(licensed under )?cc by 1 0
cc-by|50|cc by|(licensed under |released under )cc by
cc-by-nc-nd-4.0|95|creative|creative commons attribution non ?commercial no ?deriv(ative|atives|s)( works)? 4 0( international)?
cc-by-nc-nd|80|creative|creative commons attribution non ?commercial no ?deriv(ative|atives|s)
cc-by-nc-sa-4.0|95|creative|creative commons attribution non ?commercial share ?alike 4 0( international)?
cc-by-nc-sa|80|creative|creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0|90|creative|creative commons attribution non ?commercial 4 0( international)?
cc-by-nc|75|creative|creative commons attribution non ?commercial
cc-by-nd-4.0|90|creative|creative commons attribution no ?deriv(ative|atives|s)( works)? 4 0( international)?
cc-by-nd|75|creative|creative commons attribution no ?deriv(ative|atives|s)
cc-by-sa-4.0|90|creative|creative commons attribution share ?alike 4 0( international)?
cc-by-sa-3.0|90|creative|creative commons attribution share ?alike 3 0( unported)?
cc-by-sa|75|creative|creative commons attribution share ?alike
cc-by-4.0|85|creative|creative commons attribution 4 0( international)?
cc-by-3.0|85|creative|creative commons attribution 3 0( unported)?
cc-by|50|creative|creative commons attribution
cc|30|creative|creative commons( licen[cs]e)?
cc-by|70|creativecommons|creativecommons org licenses by [1-4] [05]
cc-by-sa|70|creativecommons|creativecommons org licenses by sa [1-4] [05]
cc-by-nc|70|creativecommons|creativecommons org licenses by nc [1-4] [05]
cc-by-nd|70|creativecommons|creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa|70|creativecommons|creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd|70|creativecommons|creativecommons org licenses by nc nd [1-4] [05]
cc-pdm-1.0|80|domain|public domain mark( 1 0)?
public-domain|50|domain|(released|placed|dedicated) (in|into|to) the public domain
public-domain|20|domain|(in the )?public domain
proprietary|60|proprietary|proprietary and confidential
proprietary|60|confidential|confidential and proprietary
proprietary|50|unauthorized|unauthorized (copying|reproduction|distribution)( of this file)?( via any medium)? is strictly prohibited
proprietary|40|proprietary|proprietary licen[cs]e
proprietary|50|commercial|for non ?commercial use only
reserved|25|reserved|(copyright .{0,60}?)?all rights reserved
reserved|20|reserved|(some|no) rights reserved
copyright|20|copyright|copyright( c)? (19|20)[0-9]{2}( (19|20)[0-9]{2})?
"""
