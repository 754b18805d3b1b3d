"""Signatures of license texts, written by hand from the notices themselves: label, a word of every match that gates the rule,
priority, and an expression over lower-case words parted by single spaces. 5: wording of one license alone; 4: wording that a
family shares; 3: how a text names or grants it; 2 and 1: clauses that many share."""

from __future__ import annotations

NOTICES: list[tuple[str, str, int, str]] = [
    # MIT and its kin
    ("mit", "permission", 5, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", 5, "use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", 4, "shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 4, "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("mit", "tort", 4, "whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("mit-0", "attribution", 4, "mit no attribution"),
    ("x11", "consortium", 5, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("hpnd", "supporting", 5, "and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", "representations", 4, "makes no representations about the suitability of this software for any purpose"),
    ("ntp", "publicity", 4, "not be used in advertising or publicity pertaining to distribution of the software without specific(?: written)? prior permission"),
    ("isc", "permission", 5, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "author", 4, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", "zero", 4, "(?:bsd zero clause|zero clause bsd)(?: license)?"),
    ("curl", "curl", 3, "licensed under the curl license"),
    ("mit", "jquery", 3, "released under the mit license jquery"),
    # BSD
    ("bsd", "redistribution", 5, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 4, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce", 4, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "endorse", 4, "neither the name of .{1,60}? nor the names of its contributors may be used to endorse"),
    ("bsd-4", "advertising", 5, "all advertising materials mentioning features or use of this software must display the following acknowledg?ement"),
    ("bsd", "regents", 4, "copyright(?: c)?(?: [0-9]{4}){0,9} the regents of the university of california"),
    ("bsd", "exemplary", 3, "direct indirect incidental special exemplary or consequential damages"),
    ("bsd-views", "freebsd", 5, "should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd-patent", "patent", 4, "bsd(?: 2 clause)? plus patent license"),
    ("bsd-clear", "express", 5, "no express or implied licenses to any party s patent rights are granted by this license"),
    # GPL family
    ("gpl", "redistribute", 5, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "useful", 3, "is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "franklin", 3, "free software foundation inc 51 franklin (?:street|st) fifth floor boston ma"),
    ("gpl", "temple", 3, "free software foundation inc 59 temple place suite 330 boston ma"),
    ("gpl", "mass", 3, "free software foundation inc 675 mass ave cambridge ma"),
    ("gpl", "guarantee", 5, "the gnu general public license is intended to guarantee your freedom to share and change"),
    ("gpl", "designed", 5, "the licenses for most software are designed to take away your freedom"),
    ("gpl", "gnu", 3, "you should have received a copy of the gnu general public license along with"),
    ("gpl-classpath", "linking", 5, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-classpath", "classpath", 4, "classpath exception(?: 2 0)?"),
    ("gpl-gcc", "gcc", 4, "gcc runtime library exception"),
    ("gpl-font", "embed", 5, "if you create a document which uses this font and embed this font or unaltered portions"),
    ("gpl-autoconf", "autoconf", 4, "autoconf(?: configure script)? exception"),
    ("gpl-linux", "kernel", 5, "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("gpl-linux", "syscall", 4, "linux syscall note"),
    ("gpl-openssl", "openssl", 4, "permission to link (?:the code of portions of )?this program with the openssl library"),
    ("lgpl", "redistribute", 5, "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "lesser", 3, "you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", "library", 3, "gnu library general public license"),
    ("lgpl", "combined", 5, "you may convey a combined work under terms of your choice"),
    ("agpl", "redistribute", 5, "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "interacting", 5, "all users interacting with it remotely through a computer network"),
    ("agpl", "affero", 3, "you should have received a copy of the gnu affero general public license along with"),
    ("gfdl", "invariant", 5, "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gfdl", "documentation", 4, "(?:under the terms of the )?gnu free documentation license"),
    ("gpl", "copying", 2, "see the file copying for (?:more )?details"),
    # Apache
    ("apache", "apache", 5, "licensed under the apache license version 2 0(?: the license)?"),
    ("apache", "compliance", 4, "you may not use this file except in compliance with the license"),
    ("apache", "conditions", 3, "without warranties or conditions of any kind either express or implied see the license for the specific language"),
    ("apache", "agreed", 3, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "asf", 4, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "grants", 4, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache", 5, "this product includes software developed by the apache software foundation"),
    ("apache", "appendix", 4, "appendix how to apply the apache license to your work"),
    ("apache-llvm", "llvm", 4, "apache license v?2 0 with llvm exceptions?|llvm exceptions? to the apache 2 0 license"),
    # Mozilla, Eclipse, CDDL and other file-level licenses
    ("mpl", "mozilla", 5, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "incompatible", 5, "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "netscape", 3, "the original code is .{1,80}? the initial developer of the original code is netscape"),
    ("mpl-1.1", "mozilla", 5, "the contents of this file are subject to the mozilla public license version"),
    ("npl", "netscape", 5, "the contents of this file are subject to the netscape public license"),
    ("epl", "eclipse", 5, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl", "eclipse", 4, "eclipse distribution license v?(?:ersion )?1 0"),
    ("cpl", "common", 4, "common public license (?:version |v)?1 0"),
    ("ipl", "ibm", 4, "ibm public license (?:version )?1 0"),
    ("cddl", "common", 5, "common development and distribution license(?: version)?(?: 1 [01])?"),
    ("cddl", "cddlpage", 3, "you can obtain a copy of the license at .{1,60}? cddlpage"),
    ("sissl", "industry", 4, "sun industry standards source license"),
    ("sunpublic", "sun", 4, "sun public license version 1 0"),
    ("cpal", "attribution", 4, "common public attribution license"),
    ("cpal", "cpal", 3, "cpal 1 0"),
    ("osl", "open", 4, "licensed under the open software license version [0-9](?: [0-9])?"),
    ("afl", "academic", 4, "(?:licensed under the )?academic free license(?: version)? [0-9](?: [0-9])?"),
    ("apsl", "apple", 5, "apple public source license(?: version)?(?: [0-9] [0-9])?"),
    ("rpl", "reciprocal", 4, "reciprocal public license(?: 1 [15])?"),
    ("qpl", "q", 4, "the q public license version 1 0"),
    ("nokia", "nokia", 4, "nokia open source license"),
    ("catosl", "computer", 3, "computer associates trusted open source license"),
    ("ms-pl", "microsoft", 4, "microsoft public license ms pl"),
    ("ms-rl", "microsoft", 4, "microsoft reciprocal license ms rl"),
    ("eupl", "european", 5, "(?:licensed under the )?european union public licen[cs]e(?: version)?(?: 1 [012])?"),
    ("eupl", "commission", 5, "as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("cecill", "cecill", 4, "governed by the cecill(?: [bc])? license under french law"),
    ("cecill", "abiding", 4, "abiding by the rules of distribution of free software"),
    ("lilq", "libre", 3, "licence libre du quebec"),
    ("ecl", "educational", 4, "educational community license(?: version)?(?: [12] 0)?"),
    ("nasa", "nasa", 4, "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("upl", "universal", 4, "universal permissive license(?: upl)?(?: version)?(?: 1 0)?"),
    ("mulan", "mulan", 4, "mulan (?:psl|permissive software license)(?: v2)?"),
    ("vim", "vim", 4, "vim license|under the vim licence"),
    ("ruby", "ruby", 3, "you may distribute the software under the ruby license|ruby s license"),
    ("perl", "perl", 4, "under the same terms as perl itself"),
    ("artistic", "artistic", 5, "the artistic license preamble|everyone is permitted to copy and distribute verbatim copies of this artistic license"),
    ("php", "php", 5, "this source file is subject to version (?:2 0|3 0|3 01) of the php license"),
    ("php", "php", 4, "this product includes php software freely available from"),
    ("zend", "zend", 4, "zend engine license(?: version)?(?: 2 0)?"),
    ("python", "python", 5, "python software foundation license version 2"),
    ("python", "beopen", 4, "beopen python open source license agreement"),
    ("python", "cwi", 4, "cwi license agreement for python"),
    ("python", "cnri", 4, "cnri open source license agreement|cnri python license"),
    ("zope", "zope", 4, "zope public license(?: zpl)?(?: version)?(?: 2 [01])?"),
    ("tcl", "tcl", 3, "tcl tk license|licensed under the tcl license"),
    ("openssl", "openssl", 5, "this product includes software developed by the openssl project"),
    ("ssleay", "eay", 5, "this product includes cryptographic software written by eric young eay"),
    ("openldap", "openldap", 5, "the openldap public license version 2 [0-9]"),
    ("sleepycat", "sleepycat", 4, "the sleepycat license|sleepycat software inc"),
    ("libpng", "png", 5, "png reference library license version 2|the png reference library is supplied as is"),
    ("libtiff", "leffler", 4, "sam leffler and silicon graphics"),
    ("ijg", "jpeg", 5, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", 5, "portions of this software are copyright .{1,20}? the freetype project"),
    ("freetype", "freetype", 4, "the freetype project license"),
    ("zlib", "implied", 4, "this software is provided as is without any express or implied warranty in no event"),
    ("zlib", "misrepresented", 5, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 5, "altered source versions must be plainly marked as such"),
    ("bzip2", "seward", 4, "julian seward cambridge uk"),
    ("bzip2", "bzip2", 3, "bzip2 (?:and libbzip2 )?license"),
    ("info-zip", "zip", 4, "info zip license|this is version [0-9]{4} [0-9]{2} [0-9]{2} of the info zip copyright and license"),
    ("boost", "boost", 5, "boost software license version 1 0"),
    ("boost", "executable", 5, "solely in the form of machine executable object code generated by a source language processor"),
    ("ncsa", "ncsa", 4, "university of illinois ncsa open source license"),
    ("ncsa", "developed", 4, "developed by university of illinois at urbana champaign"),
    ("w3c", "w3c", 4, "w3c software (?:and document )?notice and license|w3c document license"),
    ("icu", "icu", 4, "icu license icu 1 8 1 and later"),
    ("unicode", "unicode", 4, "unicode license agreement data files and software|unicode license v3"),
    ("json", "evil", 5, "the software shall be used for good not evil"),
    ("beerware", "beer", 5, "you can buy me a beer in return|the beer ware license"),
    ("wtfpl", "fuck", 5, "do what the fuck you want to public license"),
    ("unlicense", "unencumbered", 5, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", 4, "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", "dedicated", 4, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "cc0", 4, "cc0 1 0 universal(?: public domain dedication)?"),
    ("pddl", "pddl", 4, "open data commons public domain dedication(?: and license)? pddl|pddl 1 0"),
    ("odbl", "odbl", 4, "open data commons open database license odbl|odbl 1 0"),
    ("odc-by", "odc", 4, "odc by 1 0|odc attribution license"),
    ("ogl", "government", 5, "contains public sector information licensed under the open government licence"),
    ("ogl", "ogl", 4, "open government licence ogl|ogl v3 0"),
    ("etalab", "etalab", 4, "licence ouverte (?:open licence )?etalab|etalab 2 0"),
    ("dl-de", "datenlizenz", 4, "datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    ("cdla", "cdla", 4, "community data license agreement cdla|cdla (?:permissive|sharing)(?: [12] 0)?"),
    ("cc-by", "attribution", 3, "this work is licensed under a creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)?(?: license)"),
    ("cc-by-sa", "sharealike", 4, "this work is licensed under a creative commons attribution sharealike(?: [0-9] [0-9])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-sa", "share", 4, "this work is licensed under a creative commons attribution share alike(?: [0-9] [0-9])?"),
    ("cc-by-nc", "noncommercial", 4, "this work is licensed under a creative commons attribution noncommercial(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", "noncommercial", 5, "this work is licensed under a creative commons attribution noncommercial sharealike(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", "noderivatives", 5, "this work is licensed under a creative commons attribution noncommercial noderivatives(?: [0-9] [0-9])?"),
    ("cc-by-nd", "noderivatives", 4, "this work is licensed under a creative commons attribution noderivatives(?: [0-9] [0-9])?"),
    ("cc-by", "creativecommons", 3, "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 3, "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 3, "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 3, "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 3, "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 3, "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", 3, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", 3, "creativecommons org publicdomain mark 1 0"),
    ("ofl", "font", 5, "this font software is licensed under the sil open font license"),
    ("ofl", "reserved", 4, "with reserved font name"),
    ("ufl", "ubuntu", 4, "ubuntu font licen[cs]e(?: version)?(?: 1 0)?"),
    ("bitstream-vera", "bitstream", 5, "bitstream vera is a trademark of bitstream inc"),
    ("lppl", "latex", 5, "(?:under the conditions of the )?latex project public license"),
    ("lppl", "lppl", 3, "lppl version 1 3c?"),
    ("lppl", "maintained", 4, "this work has the lppl maintenance status maintained"),
    ("free-art", "art", 4, "free art licen[cs]e|licence art libre"),
    ("dsl", "design", 3, "design science license"),
    ("opl", "publication", 4, "open publication license v?(?:ersion )?1 0"),
    # licenses that are not open
    ("bsl", "business", 5, "business source license 1 1"),
    ("bsl", "change", 4, "change date .{1,40}? change license"),
    ("sspl", "sspl", 4, "server side public license(?: version)?(?: 1)?(?: sspl)|sspl v?1"),
    ("elastic", "elastic", 4, "elastic license(?: version)? 2 0|licensed under the elastic license"),
    ("commons-clause", "commons", 5, "commons clause license condition v1 0"),
    ("polyform", "polyform", 4, "polyform (?:noncommercial|small business|strict|perimeter|shield|free trial|internal use) license(?: 1 0 [01])?"),
    ("prosperity", "prosperity", 4, "the prosperity public license"),
    ("parity", "parity", 4, "the parity public license"),
    ("rail", "openrail", 4, "openrail m license|creativeml openrail m|bigscience openrail m"),
    ("llama", "llama", 4, "llama (?:2|3|3 1|3 2) community license agreement"),
    ("gemma", "gemma", 4, "gemma terms of use"),
    ("proprietary", "proprietary", 3, "proprietary and confidential"),
    ("proprietary", "unauthorized", 3, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "disclosed", 3, "may not be used copied or disclosed (?:except|without)"),
    ("proprietary", "reverse", 3, "you may not reverse engineer decompile or disassemble"),
    ("proprietary", "eula", 3, "end user license agreement eula"),
    ("proprietary", "evaluation", 3, "for evaluation purposes only"),
    ("non-commercial", "commercial", 2, "for non commercial (?:use|purposes) only"),
    ("non-commercial", "academic", 2, "for academic (?:use|purposes) only"),
    ("research-only", "research", 2, "for research (?:use|purposes) only"),
    ("no-derivatives", "derivative", 2, "no derivative works are permitted"),
    ("no-redistribution", "redistributed", 2, "may not be (?:published broadcast rewritten or )?redistributed without (?:prior )?permission"),
    ("reserved", "reproduced", 3, "no part of this (?:publication|book|document|work) may be reproduced"),
    ("reserved", "transmitted", 2, "stored in a retrieval system or transmitted in any form or by any means"),
    # clauses that many share
    ("public-domain", "domain", 2, "(?:in|into|to) the public domain"),
    ("public-domain", "government", 3, "this is a work of the (?:u s|united states) government"),
    ("warranty", "warranty", 1, "without warranty of any kind"),
    ("warranty", "merchantability", 1, "warranties of merchantability and fitness"),
    ("warranty", "liable", 1, "in no event shall the (?:author|authors|copyright holder|copyright holders|contributors) be liable"),
    ("patent", "patent", 2, "royalty free patent license|grants? you a patent license"),
    ("trademark", "trademarks", 1, "all (?:other )?trademarks are the property of their respective owners"),
    ("copyright", "copyright", 1, "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("copyright", "copyrighted", 1, "(?:is|are) copyrighted by"),
    ("reserved", "reserved", 1, "all rights reserved"),
    ("reserved", "reserved", 2, "(?:some|no) rights reserved"),
    ("gpl", "general", 1, "general public license"),
    ("cc-by", "cc", 1, "cc by"),
    ("attribution", "attribution", 1, "attribution (?:is )?required|with (?:proper )?attribution"),
    ("permission", "permission", 1, "(?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission"),
    ("verbatim", "verbatim", 2, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("fair-use", "fair", 1, "fair use (?:doctrine|notice|of copyrighted)"),
]
