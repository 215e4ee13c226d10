"""Signatures of licenses by sentences of their texts and of the notices that name them, each written out by hand.

Patterns run over words: lower-case letters and digits, one space apart. A keyword, or one of several, stands in every match of its pattern.
"""

#: label, pattern, keyword or keywords.
WORDINGS = (
    # permissive texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright holders be liable"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish", "deal in the software without restriction"),
    ("mit", "see (?:the )?licen[sc]e(?: file)? for (?:the )?mit (?:terms|details)", " mit "),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "mit no attribution"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}?without restriction .{0,200}?to permit persons to whom the software is furnished to do so the software is provided", "hereby granted"),
    ("mit-advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by", "advertising materials mentioning"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium"),
    ("x11-distribute", "to use copy modify merge publish distribute distribute with modifications sublicense and or sell copies", "distribute with modifications"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "author disclaims all warranties"),
    ("0bsd", "(?:bsd zero clause|zero clause bsd|0 ?bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "must reproduce the above copyright notice"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", "copyright holders and contributors as is"),
    ("bsd", "use of this source code is governed by a bsd style licen[sc]e", "governed by a bsd"),
    ("bsd-3", "neither the name of (?:the )?(?:copyright holder|\\w+(?: \\w+){0,6}?) nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising materials mentioning"),
    ("bsd-4", "(?:4|four) clause bsd(?: licen[sc]e)?", "clause bsd"),
    ("bsd-patent", "bsd 2 clause plus patent(?: licen[sc]e)?", "plus patent"),
    ("bsd-3-clear", "(?:the )?clear bsd licen[sc]e", "clear bsd"),
    ("bsd-source-code", "bsd source code attribution", "source code attribution"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "may not use this file except in compliance"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("apache-2", "https? www apache org licenses license 2 0", "apache org licenses"),
    ("apache-2", "apache license version 2 0 january 2004", "january 2004"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed on an as is basis"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "no charge royalty free irrevocable"),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation", "included with the redistribution"),
    ("zlib", "altered source versions must be plainly marked as such", "altered source"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not be misrepresented"),
    ("zlib-acknowledgement", "an acknowledgment in the product documentation is required", "acknowledgment in the product documentation is required"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software"),
    ("ncsa", "university of illinois ncsa open source licen[sc]e", "ncsa open source"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies", "appear in all copies"),
    ("hpnd", "historical permission notice and disclaimer", "historical permission notice"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice", "its documentation for any purpose with or without fee"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear in all copies"),
    ("python", "python software foundation license version 2", "python software foundation"),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby grants"),
    ("cnri-python", "cnri open source licen[sc]e agreement", "cnri open source"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl toolkit"),
    ("openssl", "openssl(?: project)? licen[sc]e", "openssl"),
    ("ssleay", "this package is an ssl implementation written by eric young", "ssl implementation written by"),
    ("libpng", "the png reference library is supplied as is", "png reference library"),
    ("libpng-2", "png reference library license version 2", "png reference library"),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that .{0,80}?sam leffler", "sam leffler"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("bzip2", "bzip2 and libbzip2 licen[sc]e", "libbzip2"),
    ("info-zip", "info zip is hereby defined as the following set of individuals", "info zip"),
    ("ftl", "portions of this software are copyright .{0,40}?the freetype project", "freetype project"),
    ("ftl", "(?:the )?freetype (?:project )?licen[sc]e", "freetype"),
    ("icu", "unicode inc licen[sc]e agreement data files and software", "unicode inc"),
    ("unicode-3", "unicode licen[sc]e v3", "unicode licen"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained", "existing copyright notices are retained"),
    ("vim", "vim is charityware", "charityware"),
    ("w3c", "w3c software (?:and document )?(?:notice and )?licen[sc]e", "w3c software"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "using and or copying this work"),
    ("zpl-2.1", "zope public license zpl version 2 1", "zope public"),
    ("afl-3", "licensed under the academic free license version 3 0", "academic free"),
    ("ecl-2", "educational community licen[sc]e(?: version)? 2 0", "educational community"),
    ("blueoak-1", "blue oak model licen[sc]e(?: 1 0 0)?", "blue oak"),
    ("mulanpsl-2", "mulan (?:psl|permissive software licen[sc]e) ?v?2", "mulan"),
    ("upl-1", "(?:the )?universal permissive licen[sc]e(?: upl)?(?: version)?(?: 1 0)?", "universal permissive"),
    ("ms-pl", "microsoft public licen[sc]e(?: ms pl)?", "microsoft public"),
    ("ms-rl", "microsoft reciprocal licen[sc]e(?: ms rl)?", "microsoft reciprocal"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "retain this notice you can do whatever"),
    ("wtfpl", "you just do what the fuck you want to", "do what the fuck"),
    ("json", "the software shall be used for good not evil", "good not evil"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works", "this instrument is retained"),
    ("naist-2003", "nara institute of science and technology 2003", "nara institute"),
    ("xnet", "x net licen[sc]e", "x net licen"),
    ("php-3.01", "this product includes php software freely available from", "includes php software"),
    ("php-3.01", "the php licen[sc]e version 3 01", "php licen"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the (?:2 clause )?bsdl? .{0,80}?or the conditions below", "or the conditions below"),
    ("smlnj", "standard ml of new jersey copyright notice license and disclaimer", "standard ml of new jersey"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish"),
    ("unlicense", "for more information please refer to (?:https? )?unlicense org", "unlicense org"),
    ("public-domain", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain"),
    ("public-domain", "(?:is|are) (?:hereby )?(?:in|part of) the public domain", "the public domain"),
    ("public-domain", "the author(?:s)? (?:hereby )?disclaims? copyright to this source code", "copyright to this source code"),
    ("pddl-1", "(?:open data commons )?public domain dedication and licen[sc]e(?: pddl)?", "public domain dedication"),
    ("cc0", "to the extent possible under law .{0,80}?waived all copyright and related or neighboring rights", "related or neighboring rights"),
    ("cc0", "creativecommons org publicdomain zero 1 0", "publicdomain zero"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    # copyleft
    ("gpl", "this program is free software you can redistribute it and or modify it", "free software"),
    ("gpl", "you should have received a copy of the gnu general public license", "gnu general public"),
    ("gpl", "either version \\d(?: of the license)? or at your option any later version", "at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "in the hope that it will be useful"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies of this license document"),
    ("gpl-3", "gnu general public license version 3 29 june 2007", "29 june 2007"),
    ("gpl-2", "gnu general public license version 2 june 1991", "june 1991"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "either version 2 of the license"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "either version 3 of the license"),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work based on this library", "combined work based on this library"),
    ("gpl-classpath", "gnu classpath exception", "classpath exception"),
    ("gpl-bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton"),
    ("gpl-gcc", "gcc runtime library exception", "gcc runtime library"),
    ("gpl-linux-syscall", "this copyright does not cover user programs that use kernel services by normal system calls", "kernel services by normal system calls"),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "this library is free software"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "general public license"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "february 1999"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1", "either version 2 1"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3", "either version 3"),
    ("agpl", "you should have received a copy of the gnu affero general public license", "gnu affero"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3", "gnu affero"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", "19 november 2007"),
    ("agpl-1", "affero general public license version 1 march 2002", "march 2002"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "no invariant sections"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", "accompanying materials"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", "accompanying materials"),
    ("cpl-1", "common public licen[sc]e(?: version)? 1 0", "common public licen"),
    ("ipl-1", "ibm public licen[sc]e(?: version)? 1 0", "ibm public"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "common development"),
    ("cpal-1", "common public attribution licen[sc]e(?: version)?(?: 1 0)?", "common public attribution"),
    ("eupl-1.2", "licensed under the eupl(?: version)? 1 2 or as soon they will be approved", "as soon they will be approved"),
    ("eupl", "european union public licen[sc]e", "european union public"),
    ("osl-3", "licensed under the open software license version 3 0", "open software"),
    ("rpl-1.5", "reciprocal public licen[sc]e(?: version)?(?: 1 5)?", "reciprocal public"),
    ("apsl-2", "apple public source licen[sc]e(?: version)?(?: 2 0)?", "apple public source"),
    ("qpl-1", "(?:the )?q public licen[sc]e(?: version)?(?: 1 0)?", "q public licen"),
    ("lppl-1.3", "this work may be distributed and or modified under the conditions of the latex project public license", "latex project"),
    ("lppl", "latex project public licen[sc]e", "latex project"),
    ("nasa-1.3", "nasa open source agreement(?: version)?(?: 1 3)?", "nasa open source"),
    ("sleepycat", "(?:the )?sleepycat (?:public )?licen[sc]e", "sleepycat"),
    ("sissl", "sun industry standards source licen[sc]e", "sun industry standards"),
    ("spl-1", "sun public licen[sc]e(?: version)?(?: 1 0)?", "sun public"),
    ("watcom-1", "sybase open watcom public licen[sc]e", "open watcom"),
    ("artistic", "the artistic license preamble the intent of this document is to state the conditions", "intent of this document"),
    ("artistic", "same terms as perl(?: itself)?", "terms as perl"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "font software"),
    ("ofl-1.1", "scripts sil org ofl", "sil org ofl"),
    ("cecill-2", "(?:this software is )?governed by the cecill(?: [bc])? licen[sc]e under french law", "under french law"),
    ("ms-opentype", "bitstream vera fonts copyright", "bitstream vera"),
    ("ubuntu-font-1", "ubuntu font licen[sc]e(?: version)?(?: 1 0)?", "ubuntu font"),
    ("odbl-1", "open data commons open database licen[sc]e(?: odbl)?", "open data commons"),
    ("odc-by-1", "open data commons attribution licen[sc]e", "open data commons"),
    ("cdla-permissive", "community data licen[sc]e agreement permissive(?: version)?", "community data licen"),
    ("cdla-sharing", "community data licen[sc]e agreement sharing(?: version)?", "community data licen"),
    ("ogl-uk-3", "contains public sector information licensed under the open government licence v3 0", "open government licen"),
    ("ogl-uk", "open government licen[sc]e(?: v\\d 0)?", "open government licen"),
    ("etalab-2", "licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", "licence ouverte"),
    ("dl-de-by-2", "datenlizenz deutschland namensnennung(?: version)? 2 0", "datenlizenz deutschland"),
    ("dl-de-zero-2", "datenlizenz deutschland zero(?: version)? 2 0", "datenlizenz deutschland"),
    # source available, content and model licenses
    ("sspl-1", "server side public license version 1 october 16 2018", "server side public"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "non production use"),
    ("busl-1.1", "business source license 1 1 parameters", "business source"),
    ("commons-clause", "commons clause licen[sc]e condition", "commons clause"),
    ("polyform-noncommercial", "polyform noncommercial licen[sc]e(?: 1 0 0)?", "polyform"),
    ("polyform-small-business", "polyform small business licen[sc]e(?: 1 0 0)?", "polyform"),
    ("polyform-shield", "polyform shield licen[sc]e(?: 1 0 0)?", "polyform"),
    ("polyform-strict", "polyform strict licen[sc]e(?: 1 0 0)?", "polyform"),
    ("fsl-1.1", "functional source licen[sc]e(?: version)?(?: 1 1)?", "functional source"),
    ("parity-7", "(?:the )?parity public licen[sc]e(?: 7 0 0)?", "parity public"),
    ("prosperity-3", "(?:the )?prosperity public licen[sc]e(?: 3 0 0)?", "prosperity public"),
    ("hippocratic-2", "hippocratic licen[sc]e(?: version)?(?: [23] \\d)?", "hippocratic"),
    ("openrail", "(?:creativeml )?open ?rail(?: \\+\\+)?(?: m)? licen[sc]e", "rail"),
    ("openrail", "responsible ai licen[sc]e", "responsible ai"),
    ("llama", "llama \\d(?: \\d)? community licen[sc]e agreement", "community licen"),
    ("gemma", "gemma terms of use", "gemma terms"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike licen[sc]e", "attribution sharealike"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international licen[sc]e", "attribution 4 0 international"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international licen[sc]e", "attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international licen[sc]e", "attribution noncommercial 4 0"),
    ("cc-by-nc-sa-4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international licen[sc]e", "noncommercial sharealike 4 0"),
    ("cc-by-nc-nd-4.0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international licen[sc]e", "noncommercial noderivatives 4 0"),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international licen[sc]e", "attribution noderivatives 4 0"),
    ("cc-by-nc", "you may not use (?:the|this) (?:material|work) for commercial purposes", "for commercial purposes"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e", "remix transform or build upon"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix transform or build upon"),
    # rights that are kept
    ("proprietary", "all rights reserved", "rights reserved"),
    ("proprietary", "tous droits réservés", "tous droits"),
    ("proprietary", "alle rechte vorbehalten", "rechte vorbehalten"),
    ("proprietary", "todos los derechos reservados", "derechos reservados"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("proprietary", "no part of this (?:publication|document|work) may be reproduced", "may be reproduced"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|software|work) (?:via any medium )?is (?:strictly )?prohibited", "unauthori"),
    ("proprietary", "this (?:software|document|file) (?:is|contains) (?:the )?(?:proprietary|confidential)(?: information| property)?", ("proprietary", "confidential")),
    ("proprietary", "may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:written )?(?:permission|consent)", ("may not be copied", "may not be reproduced", "may not be distributed")),
    ("evaluation", "for evaluation purposes only", "evaluation purposes only"),
    ("academic-use", "for (?:academic|research|non commercial research) (?:use|purposes) only", ("use only", "purposes only")),
    ("commercial", "(?:this software is )?licensed not sold", "licensed not sold"),
    ("commercial", "end user licen[sc]e agreement", "end user licen"),
)
