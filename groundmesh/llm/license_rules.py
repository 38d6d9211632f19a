"""Signature rules of licenses, written by hand: label, priority, regex over lower-case words between single spaces.

A rule's first word is its keyword; the regex is tried only where that word stands. Priority 1 is a sentence of a license
text or grant, 2 an identifier or address, 3 a name with its version, 4 a bare name. Order counts between equals.
"""

RULES_TEXT = """
mit 1 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 1 (released|licensed|available|distributed|published|provided) under the( terms of the)? mit license
mit 1 this (software|project|package|code|library|work) is( released| licensed| available| distributed)? under the( terms of the)? mit license
mit 2 spdx license identifier mit
mit 2 opensource org licenses? mit( license)?( php| html)?
mit 2 license mit
mit 3 the mit license mit
mit 3 mit expat license
mit 4 expat license
mit 4 mit license
mit 4 mit licensed
mit-0 2 spdx license identifier mit 0
mit-0 3 mit no attribution license
mit-advertising 3 mit license with advertising( clause)?
x11 2 spdx license identifier x11
x11 3 x11 license
x11 1 permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
isc 1 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 1 permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc 1 (released|licensed|available|distributed) under the( terms of the)? isc license
isc 2 spdx license identifier isc
isc 2 opensource org licenses? isc( license)?
isc 4 isc license
0bsd 2 spdx license identifier 0bsd
0bsd 3 bsd zero clause license
0bsd 3 zero clause bsd license
0bsd 3 0bsd license
bsd 1 redistribution and use in source and binary forms with or without modification are permitted
bsd 1 use of this source code is governed by a bsd style license
bsd 1 (released|licensed|available|distributed) under the( terms of the)? bsd license
bsd 4 bsd style license
bsd 4 bsd license
bsd 4 bsd licensed
bsd-1-clause 2 spdx license identifier bsd 1 clause
bsd-1-clause 3 bsd 1 clause license
bsd-2-clause 2 spdx license identifier bsd 2 clause
bsd-2-clause 2 opensource org licenses? bsd 2 clause
bsd-2-clause 3 bsd 2 clause( simplified)? license
bsd-2-clause 3 2 clause bsd license
bsd-2-clause 3 two clause bsd license
bsd-2-clause 3 simplified bsd license
bsd-2-clause 3 freebsd license
bsd-2-clause-patent 2 spdx license identifier bsd 2 clause patent
bsd-3-clause 1 neither the name of( the)?( \\w+){1,6} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause 2 spdx license identifier bsd 3 clause
bsd-3-clause 2 opensource org licenses? bsd 3 clause
bsd-3-clause 3 bsd 3 clause( new or revised)? license
bsd-3-clause 3 3 clause bsd license
bsd-3-clause 3 three clause bsd license
bsd-3-clause 3 new bsd license
bsd-3-clause 3 modified bsd license
bsd-3-clause 3 revised bsd license
bsd-3-clause-clear 2 spdx license identifier bsd 3 clause clear
bsd-3-clause-clear 3 clear bsd license
bsd-4-clause 2 spdx license identifier bsd 4 clause
bsd-4-clause 3 bsd 4 clause license
bsd-4-clause 3 original bsd license
bsd-4-clause 3 four clause bsd license
bsd-4-clause 1 all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 1 licensed under the apache license version 2( 0)?( the license)?
apache-2.0 1 (released|available|distributed|provided) under the( terms of the)? apache( software)? license version 2( 0)?
apache-2.0 1 you may obtain a copy of the license at https?( www)? apache org licenses license 2 0
apache-2.0 1 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 2 spdx license identifier apache 2 0
apache-2.0 2 apache org licenses license 2 0( txt| html)?
apache-2.0 2 opensource org licenses? apache 2 0
apache-2.0 3 apache( software)? license( version| v)? 2( 0)?
apache-2.0 3 apache 2( 0)? license
apache-2.0 3 asl 2 0 license
apache-1.1 2 spdx license identifier apache 1 1
apache-1.1 3 apache( software)? license( version| v)? 1 1
apache-1.0 2 spdx license identifier apache 1 0
apache-1.0 3 apache( software)? license( version| v)? 1 0
apache 1 (released|licensed|available|distributed) under the( terms of the)? apache( software)? license
apache 4 apache software license
apache 4 apache license
gpl-1.0 2 spdx license identifier gpl 1 0( only)?
gpl-1.0 3 gnu general public license( version| v)? 1
gpl-1.0-or-later 2 spdx license identifier gpl 1 0 or later
gpl-1.0-or-later 1 gnu general public license( as published by the free software foundation)? either version 1( of the license)? or( at your option)? any later version
gpl-2.0 2 spdx license identifier gpl 2 0( only)?
gpl-2.0 2 gnu org licenses( old licenses)? gpl 2 0( html| txt)?
gpl-2.0 2 opensource org licenses? gpl 2 0
gpl-2.0 3 gnu general public license( gpl)?( version| v)? 2( 0)?( only)?
gpl-2.0 3 gnu gpl license v?2( 0)?
gpl-2.0 3 gpl( version)? v?2( 0)?( only)? license
gpl-2.0 3 gplv2 license
gpl-2.0 1 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2
gpl-2.0-or-later 2 spdx license identifier gpl 2 0 or later
gpl-2.0-or-later 1 gnu general public license( as published by the free software foundation)? either version 2( of the license)? or( at your option)? any later version
gpl-2.0-with-classpath 3 gnu general public license( version)? 2( only)? with( the)? classpath exception
gpl-3.0 2 spdx license identifier gpl 3 0( only)?
gpl-3.0 2 gnu org licenses gpl 3 0( html| txt)?
gpl-3.0 2 opensource org licenses? gpl 3 0
gpl-3.0 3 gnu general public license( gpl)?( version| v)? 3( 0)?( only)?
gpl-3.0 3 gnu gpl license v?3( 0)?
gpl-3.0 3 gpl( version)? v?3( 0)?( only)? license
gpl-3.0 3 gplv3 license
gpl-3.0 1 licensed under the gnu general public license( version)? 3
gpl-3.0-or-later 2 spdx license identifier gpl 3 0 or later
gpl-3.0-or-later 1 gnu general public license( as published by the free software foundation)? either version 3( of the license)? or( at your option)? any later version
gpl 1 you should have received a copy of the gnu general public license along with this program
gpl 1 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 2 gnu org licenses gpl( html| txt)?
gpl 4 gnu general public license
gpl 4 gnu gpl
gpl 4 gpl license
gpl 4 gpl licensed
gpl 4 general public license
lgpl-2.0 2 spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.0 3 gnu library general public license( version| v)? 2( 0)?
lgpl-2.1 2 spdx license identifier lgpl 2 1( only| or later)?
lgpl-2.1 2 gnu org licenses( old licenses)? lgpl 2 1( html| txt)?
lgpl-2.1 3 gnu lesser general public license( version| v)? 2 1
lgpl-2.1 1 gnu lesser general public license( as published by the free software foundation)? either version 2 1( of the license)? or( at your option)? any later version
lgpl-3.0 2 spdx license identifier lgpl 3 0( only| or later)?
lgpl-3.0 2 gnu org licenses lgpl 3 0( html| txt)?
lgpl-3.0 3 gnu lesser general public license( version| v)? 3( 0)?
lgpl-3.0 1 gnu lesser general public license( as published by the free software foundation)? either version 3( of the license)? or( at your option)? any later version
lgpl 4 gnu lesser general public license
lgpl 4 gnu library general public license
lgpl 4 lesser general public license
lgpl 4 lgpl license
agpl-3.0 2 spdx license identifier agpl 3 0( only| or later)?
agpl-3.0 2 gnu org licenses agpl 3 0( html| txt)?
agpl-3.0 3 gnu affero general public license( version| v)? 3( 0)?
agpl-3.0 1 gnu affero general public license( as published by the free software foundation)? either version 3( of the license)? or( at your option)? any later version
agpl-1.0 2 spdx license identifier agpl 1 0( only| or later)?
agpl-1.0 3 affero general public license( version| v)? 1( 0)?
agpl 4 gnu affero general public license
agpl 4 affero general public license
agpl 4 agpl license
gfdl-1.1 3 gnu free documentation license( version| v)? 1 1
gfdl-1.2 3 gnu free documentation license( version| v)? 1 2
gfdl-1.3 3 gnu free documentation license( version| v)? 1 3
gfdl-1.3 2 spdx license identifier gfdl 1 3( only| or later)?
gfdl 1 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 4 gnu free documentation license
mpl-1.0 2 spdx license identifier mpl 1 0
mpl-1.0 3 mozilla public license( version| v)? 1 0
mpl-1.1 2 spdx license identifier mpl 1 1
mpl-1.1 3 mozilla public license( version| v)? 1 1
mpl-2.0 1 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 2 spdx license identifier mpl 2 0
mpl-2.0 2 mozilla org mpl 2 0 license
mpl-2.0 2 opensource org licenses? mpl 2 0
mpl-2.0 3 mozilla public license( version| v)? 2( 0)?
mpl 4 mozilla public license
epl-1.0 2 spdx license identifier epl 1 0
epl-1.0 2 eclipse org legal epl v10 license
epl-1.0 3 eclipse public license( version| v)? 1( 0)?
epl-2.0 2 spdx license identifier epl 2 0
epl-2.0 3 eclipse public license( version| v)? 2( 0)?
epl 4 eclipse public license
edl-1.0 3 eclipse distribution license( version| v)? 1( 0)?
cddl-1.0 2 spdx license identifier cddl 1 0
cddl-1.0 3 common development and distribution license( cddl)?( version| v)? 1 0
cddl-1.1 2 spdx license identifier cddl 1 1
cddl-1.1 3 common development and distribution license( cddl)?( version| v)? 1 1
cddl 4 common development and distribution license
cpl-1.0 3 common public license( version| v)? 1( 0)?
cpl 4 common public license
cpal-1.0 3 common public attribution license( version| v)? 1( 0)?
ipl-1.0 3 ibm public license( version| v)? 1( 0)?
eupl-1.1 2 spdx license identifier eupl 1 1
eupl-1.1 3 european union public licence( version| v)? 1 1
eupl-1.2 2 spdx license identifier eupl 1 2
eupl-1.2 3 european union public licence( version| v)? 1 2
eupl 4 european union public licen(c|s)e
cecill-2.1 2 spdx license identifier cecill 2 1
cecill 4 cecill( free software)? license
artistic-1.0 2 spdx license identifier artistic 1 0
artistic-1.0 3 artistic license( version| v)? 1( 0)?
artistic-2.0 2 spdx license identifier artistic 2 0
artistic-2.0 3 artistic license( version| v)? 2( 0)?
artistic 4 artistic license
perl 1 you can redistribute it and or modify it under the same terms as perl itself
zlib 1 permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib 2 spdx license identifier zlib
zlib 3 zlib libpng license
zlib 4 zlib license
libpng 4 libpng license
bsl-1.0 1 distributed under the boost software license version 1 0
bsl-1.0 2 spdx license identifier bsl 1 0
bsl-1.0 2 boost org license 1 0( txt)?
bsl-1.0 3 boost software license( version| v)? 1( 0)?
bsl-1.0 4 boost software license
wtfpl 2 spdx license identifier wtfpl
wtfpl 3 do what the fuck you want to public license
wtfpl 4 wtfpl license
unlicense 1 this is free and unencumbered software released into the public domain
unlicense 2 spdx license identifier unlicense
unlicense 2 unlicense org( license)?
unlicense 4 the unlicense
cc0-1.0 1 to the extent possible under law( the)?( \\w+){1,6} (has|have) waived all copyright and related or neighboring rights
cc0-1.0 2 spdx license identifier cc0 1 0
cc0-1.0 2 creativecommons org publicdomain zero 1 0
cc0-1.0 3 cc0 1 0 universal( public domain dedication| license)
cc0-1.0 3 creative commons zero( v1 0 universal)?( public domain)?( license)?
cc0 4 cc0 license
cc-by-nc-nd-4.0 2 spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 2 creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 3 creative commons attribution non ?commercial no ?deriv(s|atives) 4 0( international)?( public)?( license)?
cc-by-nc-nd-3.0 2 creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-3.0 3 creative commons attribution non ?commercial no ?deriv(s|atives) 3 0( unported)?( license)?
cc-by-nc-sa-4.0 2 spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 2 creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 3 creative commons attribution non ?commercial share ?alike 4 0( international)?( public)?( license)?
cc-by-nc-sa-3.0 2 creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-3.0 3 creative commons attribution non ?commercial share ?alike 3 0( unported)?( license)?
cc-by-nc-4.0 2 spdx license identifier cc by nc 4 0
cc-by-nc-4.0 2 creativecommons org licenses by nc 4 0
cc-by-nc-4.0 3 creative commons attribution non ?commercial 4 0( international)?( public)?( license)?
cc-by-nc-3.0 2 creativecommons org licenses by nc 3 0
cc-by-nc-3.0 3 creative commons attribution non ?commercial 3 0( unported)?( license)?
cc-by-nd-4.0 2 spdx license identifier cc by nd 4 0
cc-by-nd-4.0 2 creativecommons org licenses by nd 4 0
cc-by-nd-4.0 3 creative commons attribution no ?deriv(s|atives) 4 0( international)?( public)?( license)?
cc-by-sa-4.0 2 spdx license identifier cc by sa 4 0
cc-by-sa-4.0 2 creativecommons org licenses by sa 4 0
cc-by-sa-4.0 3 creative commons attribution share ?alike 4 0( international)?( public)?( license)?
cc-by-sa-3.0 2 creativecommons org licenses by sa 3 0
cc-by-sa-3.0 3 creative commons attribution share ?alike 3 0( unported)?( license)?
cc-by-sa-2.5 2 creativecommons org licenses by sa 2 5
cc-by-sa-2.0 2 creativecommons org licenses by sa 2 0
cc-by-4.0 2 spdx license identifier cc by 4 0
cc-by-4.0 2 creativecommons org licenses by 4 0
cc-by-4.0 3 creative commons attribution 4 0( international)?( public)?( license)?
cc-by-4.0 3 cc by 4 0 license
cc-by-3.0 2 creativecommons org licenses by 3 0
cc-by-3.0 3 creative commons attribution 3 0( unported)?( license)?
cc-by-2.5 2 creativecommons org licenses by 2 5
cc-by-2.0 2 creativecommons org licenses by 2 0
cc 4 creative commons( \\w+){0,6} licen(c|s)e
cc 4 creative commons
public-domain 1 this work (is|has been released) (in|into) the public domain
public-domain 1 (released|placed|dedicated) (in|into|to) the public domain
public-domain 4 public domain dedication
ofl-1.1 2 spdx license identifier ofl 1 1
ofl-1.1 3 sil open font license( version| v)? 1 1
ofl 4 open font license
python-2.0 2 spdx license identifier python 2 0
psf-2.0 3 python software foundation license( version| v)? 2
psf 4 python software foundation license
psf 4 psf license
ruby 4 ruby license
php-3.01 2 spdx license identifier php 3 01
php-3.01 3 php license( version| v)? 3 01
php 4 php license
postgresql 2 spdx license identifier postgresql
postgresql 4 postgresql license
openssl 2 spdx license identifier openssl
openssl 4 openssl license
curl 2 spdx license identifier curl
curl 4 curl license
ncsa 2 spdx license identifier ncsa
ncsa 3 university of illinois ncsa open source license
ncsa 4 ncsa open source license
w3c 2 spdx license identifier w3c
w3c 4 w3c software( notice and)? license
vim 4 vim license
json 1 the software shall be used for good not evil
json 4 json license
ms-pl 2 spdx license identifier ms pl
ms-pl 3 microsoft public license( ms pl)?
ms-rl 2 spdx license identifier ms rl
ms-rl 3 microsoft reciprocal license( ms rl)?
osl-3.0 2 spdx license identifier osl 3 0
osl-3.0 3 open software license( version| v)? 3( 0)?
osl 4 open software license
afl-3.0 2 spdx license identifier afl 3 0
afl-3.0 3 academic free license( version| v)? 3( 0)?
afl 4 academic free license
odbl-1.0 2 spdx license identifier odbl 1 0
odbl-1.0 2 opendatacommons org licenses odbl( 1 0)?
odbl-1.0 3 open( data commons open)? database license( odbl)?( v1 0)?
odc-by-1.0 2 opendatacommons org licenses by( 1 0)?
odc-by-1.0 3 open data commons attribution license( v1 0)?
pddl-1.0 2 opendatacommons org licenses pddl( 1 0)?
pddl-1.0 3 public domain dedication and license( v1 0)?
cdla-permissive-2.0 3 community data license agreement permissive( version)? 2 0
cdla-sharing-1.0 3 community data license agreement sharing( version)? 1 0
ecl-2.0 3 educational community license( version| v)? 2( 0)?
zpl-2.1 3 zope public license( version| v)? 2 1
upl-1.0 3 universal permissive license( version| v)? 1( 0)?
lppl-1.3c 1 this work may be distributed and or modified under the conditions of the latex project public license
lppl 4 latex project public license
qpl-1.0 3 q public license( version| v)? 1( 0)?
ijg 4 independent jpeg group license
ftl 4 freetype( project)? license
bitstream-vera 4 bitstream vera( fonts?)? license
unicode-dfs-2016 4 unicode( data files and software)? license
sleepycat 4 sleepycat license
mulan-psl-2.0 3 mulan psl v2 license
mulan-psl-2.0 3 mulan permissive software license( version| v)? 2
blueoak-1.0.0 3 blue oak model license( version)? 1 0 0
sspl-1.0 2 spdx license identifier sspl 1 0
sspl-1.0 3 server side public license( version| v)?( 1)?
busl-1.1 2 spdx license identifier busl 1 1
busl-1.1 3 business source license( version| v)? 1 1
busl 4 business source license
elastic-2.0 3 elastic license( version| v)? 2( 0)?
elastic 4 elastic license
commons-clause 3 commons clause( license)? condition( v1 0)?
polyform-noncommercial-1.0.0 3 polyform noncommercial license 1 0 0
polyform 4 polyform( \\w+){1,3} license
hippocratic-2.1 3 hippocratic license( version)? 2 1
openrail 4 (bigscience|bigcode|creativeml) open ?rail( m)? license
llama 4 llama( \\d)? community license( agreement)?
beerware 4 beerware license
beerware 1 the beer ware license
proprietary 1 all rights reserved no part of this (publication|document|book|work) may be reproduced
proprietary 1 unauthorized (copying|reproduction|distribution) of this (file|software|document)( via any medium)? is strictly prohibited
proprietary 4 end user license agreement
proprietary 4 commercial license agreement
proprietary 4 proprietary license
"""
