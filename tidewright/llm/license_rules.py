"""The signature rules of license scans, as text: priority, label, keyword, and after ``::`` the regex.

Texts are searched in lower case; a space in a regex stands for any run of white space and comment marks.  The keyword is a
literal part of every text that the regex matches.
"""

# Sentences, notices, addresses, identifiers and names by which licenses are known.
RULES = r"""
100 mit hereby :: permission is hereby granted,? free of charge,? to any person obtaining a copy(?: of this (?:software|font|file|program))?
100 mit obtaining :: to any person obtaining a copy of this software and associated documentation files
95 mit copies :: the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions
95 mit liable :: in no event shall the authors or copyright holders be liable for any claim
90 mit deal :: to deal in the software without restriction
90 mit spdx-license-identifier :: spdx-license-identifier: (?:mit|mit-0)(?![\w.-])
85 mit opensource.org :: https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
85 mit mit-license.org :: https?://(?:www\.)?mit-license\.org
80 mit mit :: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
75 mit mit :: subject to the (?:terms of the )?mit licen[cs]e
75 mit mit :: (?:dual[- ]|tri[- ])?licensed under (?:both )?(?:the )?mit (?:and|or|/)
70 mit mit :: licen[cs]e ?: ?(?:the )?mit(?![\w-])
60 mit mit :: (?<![\w-])mit[- ]licensed
60 mit mit :: (?<![\w.-])mit licen[cs]e
60 mit expat :: (?<![\w.-])expat licen[cs]e
55 x11 x11 :: (?<![\w.-])x11 licen[cs]e
90 x11 consortium :: except as contained in this notice, the name of the x consortium shall not be used
90 x11 spdx-license-identifier :: spdx-license-identifier: x11(?![\w.-])
85 mit-0 attribution :: (?<![\w.-])mit no attribution
100 isc permission :: permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
95 isc action :: whether in an action of contract, negligence or other tortious action
90 isc spdx-license-identifier :: spdx-license-identifier: isc(?![\w.-])
60 isc isc :: (?<![\w.-])isc licen[cs]e
85 0bsd 0bsd :: spdx-license-identifier: 0bsd(?![\w.-])
80 0bsd zero-clause :: zero-clause bsd
75 0bsd permission :: permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
100 bsd redistribution :: redistribution and use in source and binary forms,? with or without modification,? are permitted provided that
95 bsd redistributions :: redistributions of source code must retain the (?:above )?copyright notice
95 bsd redistributions :: redistributions in binary form must reproduce the (?:above )?copyright notice
95 bsd endorse :: neither the names? of .{1,120}? may be used to endorse or promote products derived from this software
95 bsd advertising :: all advertising materials mentioning features or use of this software must display
95 bsd regents :: copyright (?:\(c\) )?[\d, -]{4,40} the regents of the university of california
90 bsd spdx-license-identifier :: spdx-license-identifier: bsd-[1234]-clause(?:-[a-z-]+)?
85 bsd opensource.org :: opensource\.org/licenses?/bsd-[23]-clause
80 bsd bsd :: (?:licensed|released|distributed|published|available|provided) under (?:the |a )?(?:terms of )?(?:the )?(?:new |modified |simplified |revised |[234][- ]clause )?bsd(?:[- ]style)? licen[cs]e
75 bsd bsd :: use of this source code is governed by a bsd[- ]style licen[cs]e
65 bsd clause :: (?<![\w.-])bsd[- ][1234][- ]clause
60 bsd bsd :: (?<![\w.-])(?:new |modified |simplified |revised |[234][- ]clause )bsd licen[cs]e
55 bsd bsd :: (?<![\w.-])bsd licen[cs]e
50 bsd bsd-licensed :: (?<![\w.-])bsd-licensed
100 apache apache :: licensed under the apache licen[cs]e, version 2\.0
100 apache apache :: apache licen[cs]e version 2\.0, january 2004
95 apache compliance :: you may not use this file except in compliance with the licen[cs]e\. you may obtain a copy
90 apache apache.org :: https?://(?:www\.)?apache\.org/licenses/license-[12]\.[01]
95 apache foundation :: licensed to the apache software foundation \(asf\) under one or more
90 apache perpetual :: subject to the terms and conditions of this licen[cs]e, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent)
90 apache developed :: this product includes software developed (?:by|at) the apache software foundation
90 apache spdx-license-identifier :: spdx-license-identifier: apache-(?:1\.[01]|2\.0)(?![\w.-])
80 apache apache :: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e
70 apache apache :: apache(?: software)? licen[cs]e,? (?:v|version )?[12](?:\.\d)?
70 apache apache- :: (?<![\w.-])apache-[12]\.[01](?![\w.-])
65 apache apache :: licen[cs]e ?: ?(?:the )?apache(?![\w-])
60 apache apache :: (?<![\w.-])apache software licen[cs]e
55 apache apache :: (?<![\w.-])apache licen[cs]e
50 apache asl :: (?<![\w.-])asl ?2\.0
100 gpl redistribute :: is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
100 gpl general :: gnu general public licen[cs]e version [123],? (?:june|february|29 june) \d{0,2},? ?\d{4}
95 gpl verbatim :: everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed
95 gpl freedom :: the licenses for most software are designed to take away your freedom to share and change it
95 gpl copyleft :: the gnu general public licen[cs]e is a free, copyleft licen[cs]e
90 gpl received :: you should have received a copy of the gnu general public licen[cs]e
90 gpl gnu.org :: https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl
90 gpl spdx-license-identifier :: spdx-license-identifier: gpl-[123]\.0(?:\+|-only|-or-later)?
85 gpl either :: either version [123] of the (?:gnu general public )?licen[cs]e,? or \(at your option\) any later version
80 gpl general :: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e
80 gpl gpl :: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
75 gpl classpath :: gpl(?:v?2)?,? with (?:the )?classpath exception
75 gpl module_license :: module_license ?\( ?"(?:dual [a-z/ ]+|gpl(?: v2)?(?: and additional rights)?)"
70 gpl gpl :: (?<![\w.-])gpl[- ]?v?[123](?:\.0)?(?:\+|-only|-or-later)?(?![\w])
65 gpl gnu :: (?<![\w.-])gnu gpl(?![\w])
60 gpl general :: (?<![\w.-])gnu general public licen[cs]e
55 gpl general :: (?<![\w.-])general public licen[cs]e
50 gpl gpl :: (?<![\w.-])gpl[- ]licensed
50 gpl gpl-compatible :: (?<![\w.-])gpl-compatible
100 lgpl redistribute :: you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
95 lgpl incorporates :: this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3
90 lgpl received :: you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
90 lgpl gnu.org :: https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl
90 lgpl spdx-license-identifier :: spdx-license-identifier: lgpl-[23]\.[01](?:\+|-only|-or-later)?
80 lgpl general :: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
75 lgpl general :: (?<![\w.-])(?:gnu )?(?:lesser|library) general public licen[cs]e
70 lgpl lgpl :: (?<![\w.-])lgpl[- ]?v?[23](?:\.[01])?(?:\+|-only|-or-later)?
60 lgpl lgpl :: (?<![\w.-])(?:gnu )?lgpl(?![\w])
100 agpl affero :: you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e
95 agpl prominently :: notwithstanding any other provision of this licen[cs]e, if you modify the program, your modified version must prominently offer all users interacting with it remotely
90 agpl affero :: you should have received a copy of the gnu affero general public licen[cs]e
90 agpl gnu.org :: https?://(?:www\.)?gnu\.org/licenses/agpl
90 agpl spdx-license-identifier :: spdx-license-identifier: agpl-[13]\.0(?:\+|-only|-or-later)?
75 agpl affero :: (?<![\w.-])(?:gnu )?affero general public licen[cs]e
70 agpl agpl :: (?<![\w.-])agpl[- ]?v?[13](?:\.0)?(?:\+|-only|-or-later)?
60 agpl agpl :: (?<![\w.-])(?:gnu )?agpl(?![\w])
90 gfdl documentation :: permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
85 gfdl invariant :: with no invariant sections, no front-cover texts,? and no back-cover texts
70 gfdl documentation :: (?<![\w.-])gnu free documentation licen[cs]e
60 gfdl gfdl :: (?<![\w.-])gfdl(?![\w])
100 mpl mozilla :: this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0
95 mpl mozilla :: the contents of this file are subject to the mozilla public licen[cs]e version 1\.[01]
90 mpl incompatible :: this source code form is .incompatible with secondary licenses.
90 mpl mozilla.org :: https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl(?:/|(?![\w]))
90 mpl spdx-license-identifier :: spdx-license-identifier: mpl-[12]\.[01]
75 mpl mozilla :: (?<![\w.-])mozilla public licen[cs]e,? (?:v\.? ?|version )?[12]\.[01]
65 mpl mozilla :: (?<![\w.-])mozilla public licen[cs]e
60 mpl mpl :: (?<![\w.-])mpl[- ]?v?[12]\.[01]
95 epl eclipse :: this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
90 epl accompanying :: the accompanying program is provided under the terms of this eclipse public licen[cs]e
90 epl eclipse.org :: eclipse\.org/(?:legal|org/documents)/epl-(?:v10|v20|2\.0)
90 epl spdx-license-identifier :: spdx-license-identifier: epl-[12]\.0
65 epl eclipse :: (?<![\w.-])eclipse public licen[cs]e
70 edl eclipse :: (?<![\w.-])eclipse distribution licen[cs]e
90 eupl eupl :: licensed under the eupl,? (?:version|v\.?) ?1\.[012]
90 eupl spdx-license-identifier :: spdx-license-identifier: eupl-1\.[012]
65 eupl european :: (?<![\w.-])european union public licen[cs]e
95 cddl contents :: the contents of this file are subject to the terms of (?:either the gnu .{1,80}?|the )common development and distribution licen[cs]e
90 cddl spdx-license-identifier :: spdx-license-identifier: cddl-1\.[01]
65 cddl distribution :: (?<![\w.-])common development and distribution licen[cs]e
60 cddl cddl :: (?<![\w.-])cddl(?![\w])
90 cpl spdx-license-identifier :: spdx-license-identifier: cpl-1\.0
65 cpl common :: (?<![\w.-])common public licen[cs]e
70 ipl ibm :: (?<![\w.-])ibm public licen[cs]e
70 lucent lucent :: (?<![\w.-])lucent public licen[cs]e
70 cpal common :: (?<![\w.-])common public attribution licen[cs]e
100 zlib as-is :: this software is provided .{1,2}as-is.{1,2},? without any express or implied warranty\. in no event will the authors be held liable
95 zlib misrepresented :: the origin of this software must not be misrepresented
95 zlib altered :: altered source versions must be plainly marked as such
90 zlib spdx-license-identifier :: spdx-license-identifier: zlib(?:-acknowledgement)?(?![\w.-])
60 zlib zlib :: (?<![\w.-])zlib(?:/libpng)? licen[cs]e
75 libpng libpng :: this code is released under the libpng licen[cs]e
95 boost boost :: boost software licen[cs]e - version 1\.0 - august 17th,? 2003
90 boost boost :: distributed under the boost software licen[cs]e,? version 1\.0
90 boost boost.org :: https?://(?:www\.)?boost\.org/license_1_0\.txt
90 boost spdx-license-identifier :: spdx-license-identifier: bsl-1\.0
60 boost boost :: (?<![\w.-])boost software licen[cs]e
100 unlicense unencumbered :: this is free and unencumbered software released into the public domain
95 unlicense unlicense.org :: https?://(?:www\.)?unlicense\.org
90 unlicense spdx-license-identifier :: spdx-license-identifier: unlicense(?![\w.-])
60 unlicense unlicense :: (?:the )unlicense(?![\w.])
95 wtfpl fuck :: do what the fuck you want to public licen[cs]e
90 wtfpl spdx-license-identifier :: spdx-license-identifier: wtfpl
60 wtfpl wtfpl :: (?<![\w.-])wtfpl(?![\w])
100 cc0 creativecommons.org :: creativecommons\.org/publicdomain/zero/1\.0
95 cc0 waiv :: has (?:dedicated the work to the public domain by waiving|waived) all (?:of his or her |copyright and related )
90 cc0 spdx-license-identifier :: spdx-license-identifier: cc0-1\.0
75 cc0 cc0 :: (?<![\w.-])cc0(?: 1\.0)?(?: universal)?(?![\w])
70 cc0 creative :: (?<![\w.-])creative commons zero
100 cc-by creativecommons.org :: creativecommons\.org/licenses/by/[1-4]\.[05]
100 cc-by-sa creativecommons.org :: creativecommons\.org/licenses/by-sa/[1-4]\.[05]
100 cc-by-nc creativecommons.org :: creativecommons\.org/licenses/by-nc/[1-4]\.[05]
100 cc-by-nd creativecommons.org :: creativecommons\.org/licenses/by-nd/[1-4]\.[05]
100 cc-by-nc-sa creativecommons.org :: creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
100 cc-by-nc-nd creativecommons.org :: creativecommons\.org/licenses/by-n[cd]-n[cd]/[1-4]\.[05]
90 cc-by spdx-license-identifier :: spdx-license-identifier: cc-by-[1-4]\.[05]
90 cc-by-sa spdx-license-identifier :: spdx-license-identifier: cc-by-sa-[1-4]\.[05]
90 cc-by-nc spdx-license-identifier :: spdx-license-identifier: cc-by-nc-[1-4]\.[05]
90 cc-by-nc-sa spdx-license-identifier :: spdx-license-identifier: cc-by-nc-sa-[1-4]\.[05]
75 cc-by-nc-sa noncommercial :: attribution[- ]noncommercial[- ]share ?alike
75 cc-by-nc-nd noncommercial :: attribution[- ]noncommercial[- ]no ?deriv(?:ative)?s?(?:works)?
70 cc-by-sa attribution :: creative commons attribution[- ]share ?alike
70 cc-by-nc attribution :: creative commons attribution[- ]non ?commercial
70 cc-by-nd attribution :: creative commons attribution[- ]no ?deriv(?:ative)?s?
65 cc-by attribution :: creative commons attribution(?: [1-4]\.[05])?
65 cc-by-nc-sa cc :: (?<![\w.-])cc[- ]by[- ]nc[- ]sa(?![\w])
65 cc-by-nc-nd cc :: (?<![\w.-])cc[- ]by[- ]nc[- ]nd(?![\w])
62 cc-by-sa cc :: (?<![\w.-])cc[- ]by[- ]sa(?![\w])
62 cc-by-nc cc :: (?<![\w.-])cc[- ]by[- ]nc(?![\w])
62 cc-by-nd cc :: (?<![\w.-])cc[- ]by[- ]nd(?![\w])
60 cc-by cc :: (?<![\w.-])cc[- ]by(?: [1-4]\.[05])?(?![\w])
50 cc-other creative :: (?<![\w.-])creative commons licen[cs]e
90 artistic artistic :: under the (?:same )?terms (?:of|as) (?:the )?(?:perl (?:itself )?)?(?:\(?the )?artistic licen[cs]e
90 artistic spdx-license-identifier :: spdx-license-identifier: artistic-[12]\.0
85 artistic perl :: you can redistribute it and/or modify it under the same terms as perl
60 artistic artistic :: (?<![\w.-])artistic licen[cs]e
95 python python :: psf is making python available to licensee on an .as is. basis
90 python python :: python software foundation licen[cs]e(?: version 2)?
90 python spdx-license-identifier :: spdx-license-identifier: (?:psf-2\.0|python-2\.0)
60 python psf :: (?<![\w.-])psf licen[cs]e
90 php php :: this source file is subject to version [23]\.\d{1,2} of the php licen[cs]e
85 php php.net :: https?://(?:www\.)?php\.net/license
60 php php :: (?<![\w.-])php licen[cs]e
60 ruby ruby :: (?<![\w.-])(?:the )?ruby licen[cs]e
75 ruby ruby :: (?:under|on) the same terms as ruby(?: itself)?
95 openssl openssl :: this product includes software developed by the openssl project
60 openssl openssl :: (?<![\w.-])openssl licen[cs]e
95 ssleay eric :: this product includes cryptographic software written by eric young
90 postgresql university :: in no event shall the university of california be liable to any party for direct, indirect
60 postgresql postgresql :: (?<![\w.-])postgresql licen[cs]e
95 ofl sil :: this font software is licensed under the sil open font licen[cs]e,? version 1\.1
90 ofl spdx-license-identifier :: spdx-license-identifier: ofl-1\.[01]
85 ofl reserved :: with reserved font name
65 ofl font :: (?<![\w.-])(?:sil )?open font licen[cs]e
65 ms-pl microsoft :: (?<![\w.-])microsoft public licen[cs]e
65 ms-rl microsoft :: (?<![\w.-])microsoft reciprocal licen[cs]e
90 ms-pl spdx-license-identifier :: spdx-license-identifier: ms-pl
90 ms-rl spdx-license-identifier :: spdx-license-identifier: ms-rl
95 odbl made :: is made available under the open database licen[cs]e
90 odbl opendatacommons.org :: opendatacommons\.org/licenses/odbl
60 odbl database :: (?<![\w.-])open database licen[cs]e
85 pddl opendatacommons.org :: opendatacommons\.org/licenses/pddl
60 pddl dedication :: public domain dedication and licen[cs]e
85 odc-by opendatacommons.org :: opendatacommons\.org/licenses/by
60 odc-by commons :: open data commons attribution licen[cs]e
80 ogl open :: (?<![\w.-])open government licen[cs]e(?: v[123](?:\.0)?)?
95 ncsa illinois :: neither the names of .{1,80}?university of illinois
70 ncsa illinois :: university of illinois(?:/|[ -])(?:ncsa )?open source licen[cs]e
90 afl academic :: licensed under the academic free licen[cs]e
60 afl academic :: (?<![\w.-])academic free licen[cs]e
90 osl open :: licensed under the open software licen[cs]e
60 osl open :: (?<![\w.-])open software licen[cs]e
60 qpl public :: (?<![\w.-])q public licen[cs]e
60 sissl industry :: (?<![\w.-])sun industry standards source licen[cs]e
60 spl sun :: (?<![\w.-])sun public licen[cs]e
70 upl permissive :: (?<![\w.-])universal permissive licen[cs]e
90 upl spdx-license-identifier :: spdx-license-identifier: upl-1\.0
60 vim vim :: (?<![\w.-])vim licen[cs]e
85 w3c w3.org :: https?://(?:www\.)?w3\.org/consortium/legal
60 w3c w3c :: (?<![\w.-])w3c(?: software(?: and document)?)?(?: notice and)? licen[cs]e
70 apsl apple :: (?<![\w.-])apple public source licen[cs]e
90 apsl modifications :: this file contains original code and/or modifications of original code as defined in and that are subject to the apple
90 cecill cecill :: governed by the cecill(?:-[bc])? licen[cs]e under french law
60 cecill cecill :: (?<![\w.-])cecill(?:-[bc])?(?: licen[cs]e|-[12]\.[01])
70 intel intel :: (?<![\w.-])intel (?:open source|simplified software) licen[cs]e
70 nasa nasa :: (?<![\w.-])nasa open source agreement
70 lppl latex :: (?<![\w.-])latex project public licen[cs]e
90 lppl conditions :: this work may be distributed and/or modified under the conditions of the latex project public licen[cs]e
60 ecl educational :: (?<![\w.-])educational community licen[cs]e
70 rpsl realnetworks :: (?<![\w.-])realnetworks public source licen[cs]e
70 sleepycat sleepycat :: (?<![\w.-])sleepycat licen[cs]e
70 zpl zope :: (?<![\w.-])zope public licen[cs]e
70 bsl-1.1 business :: (?<![\w.-])business source licen[cs]e(?: 1\.1)?
75 sspl side :: (?<![\w.-])server side public licen[cs]e
70 elastic elastic :: (?<![\w.-])elastic licen[cs]e(?: 2\.0)?
75 polyform polyform :: polyform (?:noncommercial|small business|shield|strict|free trial|perimeter) licen[cs]e
75 commons-clause commons :: commons clause(?: license condition)?
75 openrail rail :: (?:bigscience |creativeml )?open ?rail(?:-m|\+\+-m)?(?: licen[cs]e)?
70 llama llama :: llama [23](?:\.\d)? community licen[cs]e
95 beerware beer :: if we meet some day, and you think this stuff is worth it, you can buy me a beer
60 beerware beer :: (?<![\w.-])beer-?ware licen[cs]e
80 json evil :: the software shall be used for good, not evil
70 blueoak oak :: blue oak model licen[cs]e
75 hippocratic hippocratic :: (?<![\w.-])hippocratic licen[cs]e
70 mulan mulan :: mulan (?:psl|permissive software licen[cs]e),? ?(?:v|version )?[12]
60 ntp ntp :: (?<![\w.-])ntp licen[cs]e
85 curl curl :: (?<![\w.-])copyright - (?:\d{4} - \d{4}, )?daniel stenberg.{0,40}curl
85 freetype freetype :: portions of this software are copyright .{1,40}?the freetype project
65 freetype freetype :: (?<![\w.-])freetype (?:project )?licen[cs]e
85 imagemagick imagemagick :: imagemagick licen[cs]e
85 jpeg jpeg :: this software is based in part on the work of the independent jpeg group
85 unicode unicode :: unicode,? inc\.? licen[cs]e agreement
85 unicode unicode.org :: unicode\.org/(?:copyright|license)
80 hpnd historical :: historical permission notice and disclaimer
85 smlnj jersey :: standard ml of new jersey
60 tcl tcl :: (?<![\w.-])tcl/tk licen[cs]e
70 public-domain public :: (?:placed|released|dedicated) (?:by the author )?(?:in|into|to) the public domain
60 public-domain public :: this (?:file|code|software|work|document|program) is (?:hereby )?(?:in|placed in) the public domain
50 public-domain public :: (?:in|into|to) the public domain
75 us-government government :: works? of the (?:u\.s\.|united states) government
80 proprietary confidential :: proprietary and confidential
80 proprietary unauthorized :: unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|program)
70 proprietary agreement :: end[- ]user licen[cs]e agreement
60 proprietary eula :: (?<![\w])eula(?![\w])
60 proprietary reserved :: all rights reserved
60 proprietary commercial :: (?:a|under) commercial licen[cs]e
50 free-unknown free :: (?:is|as) free software
40 unknown-reference licen :: see (?:the )?(?:file )?licen[cs]e(?:\.txt|\.md)?(?: file)? for (?:details|more|license|licensing)
40 unknown-reference copying :: see (?:the )?(?:file )?copying(?: file)? for (?:details|more|license|licensing)
40 unknown-reference distributed :: (?:license|licence) (?:file|text) (?:that was|which was)? ?distributed with this
30 unknown-notice licensed :: licensed under the (?:terms of the )?(?:following|same|above)
"""
