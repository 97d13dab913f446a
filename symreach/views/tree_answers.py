"""Known answers of the trees: edges as `from -> to`, with flags where there are any, and nodes as name, kind, line, column and flags.

Names are relative to the package, which is `.` itself. They were checked by hand against the rules of resolution."""

from __future__ import annotations

EDGES: dict[str, list[str]] = {
    "plain": [
        ".m -> .",
        ".m -> .m.late",
        ".m.Base -> .m",
        ".m.Child -> .m",
        ".m.Child -> .m.Base",
        ".m.Child -> .m.LIMIT",
        ".m.Child -> .m.helper",
        ".m.LIMIT -> .m",
        ".m.helper -> .m",
        ".m.helper -> .m.LIMIT",
        ".m.late -> .m",
        ".m.late -> .m.Child",
        ".m.os -> .m",
    ],
    "rebound": [
        ".m -> .",
        ".m -> .m.f",
        ".m -> .m.f",
        ".m.f -> .m",
        ".m.f -> .m",
        ".m.g -> .m",
        ".m.g -> .m.value",
        ".m.g -> .m.value",
        ".m.value -> .m",
        ".m.value -> .m",
    ],
    "scopes": [
        ".m -> .",
        ".m.C -> .m",
        ".m.C -> .m.item",
        ".m.C -> .m.other",
        ".m.f -> .m",
        ".m.f -> .m.other",
        ".m.h -> .m",
        ".m.h -> .m.other",
        ".m.item -> .m",
        ".m.other -> .m",
    ],
    "targets": [
        ".m -> .",
        ".m -> .m.a",
        ".m -> .m.b",
        ".m -> .m.box",
        ".m.a -> .m",
        ".m.b -> .m",
        ".m.box -> .m",
        ".m.x -> .m",
        ".m.x -> .m",
        ".m.x -> .m.a",
        ".m.x -> .m.x",
        ".m.x -> .m.y",
        ".m.y -> .m",
        ".m.y -> .m.b",
        ".m.z -> .m",
        ".m.z -> .m.b",
    ],
    "quoted": [
        ".m -> .",
        ".m.Later -> .m",
        ".m.f -> .m",
        ".m.f -> .m.Later",
        ".m.name -> .m",
        ".m.name -> .m.Later",
    ],
    "exported": [
        ".m -> .",
        ".m -> .m.__all__",
        ".m -> .m.__author__",
        ".m.__all__ -> .m",
        ".m.__all__ -> .m.shown",
        ".m.__author__ -> .m",
        ".m.hidden -> .m",
        ".m.shown -> .m",
    ],
    "overloaded": [
        ".m -> .",
        ".m.overload -> .m",
        ".m.pick -> .m",
        ".m.pick -> .m",
        ".m.pick -> .m",
        ".m.pick -> .m.overload",
        ".m.pick -> .m.overload",
        ".m.pick -> .m.pick",
        ".m.pick -> .m.pick",
    ],
    "branches": [
        ".m -> .",
        ".m -> .m.OFF",
        ".m -> .m.TYPE_CHECKING",
        ".m -> .m.used 1",
        ".m.OFF -> .m",
        ".m.TYPE_CHECKING -> .m",
        ".m.f -> .m",
        ".m.f -> .m.used 1",
        ".m.kind -> .m",
        ".m.kind -> .m.used",
        ".m.used -> .m",
    ],
    "pinned": [
        ".a -> .",
        ".a.x -> .a",
        ".b -> .",
        ".m -> .",
        ".m.pinned§ -> .a",
        ".m.pinned§ -> .b",
        ".m.pinned§ -> .m",
        ".m.pinned§ -> .m",
        ".m.x -> .a",
        ".m.x -> .a.x",
        ".m.x -> .m",
    ],
    "aliases": [
        ".m -> .",
        ".m.aliases§ -> .m",
        ".m.aliases§ -> .tools",
        ".m.one -> .m",
        ".m.one -> .m.t",
        ".m.one -> .tools",
        ".m.one -> .tools.make",
        ".m.t -> .m",
        ".m.t -> .tools",
        ".m.three -> .m",
        ".m.three -> .m.aliases§",
        ".m.three -> .tools",
        ".m.three -> .tools.make",
        ".m.two -> .m",
        ".m.two -> .m.u",
        ".m.two -> .tools",
        ".m.two -> .tools.make",
        ".m.u -> .m",
        ".m.u -> .tools",
        ".tools -> .",
        ".tools.make -> .tools",
    ],
    "nested": [
        ".m -> .",
        ".m.f -> .m",
        ".m.f -> .tools",
        ".m.f -> .tools.make",
        ".m.g -> .m",
        ".m.g -> .tools",
        ".m.g -> .tools.make",
        ".tools -> .",
        ".tools.make -> .tools",
    ],
    "stars": [
        ".low -> .",
        ".low._shut -> .low",
        ".low.open_ -> .low",
        ".mid -> .",
        ".mid.*stars§.low -> .low",
        ".mid.*stars§.low -> .mid",
        ".mid.open_ -> .mid",
        ".mid.open_ -> .mid.*stars§.low",
        ".mid.twice -> .low",
        ".mid.twice -> .low.open_",
        ".mid.twice -> .mid",
        ".mid.twice -> .mid.open_",
        ".top -> .",
        ".top.*stars§.mid -> .mid",
        ".top.*stars§.mid -> .top",
        ".top.WIDE -> .mid",
        ".top.WIDE -> .mid.twice",
        ".top.WIDE -> .top",
        ".top.WIDE -> .top.twice",
        ".top.open_ -> .top",
        ".top.open_ -> .top.*stars§.mid",
        ".top.twice -> .top",
        ".top.twice -> .top.*stars§.mid",
        ".user -> .",
        ".user.Door -> .top",
        ".user.Door -> .top.open_",
        ".user.Door -> .top.twice",
        ".user.Door -> .user",
        ".user.Door -> .user.open_",
        ".user.Door -> .user.top",
        ".user.WIDE -> .top",
        ".user.WIDE -> .top.WIDE",
        ".user.WIDE -> .user",
        ".user.open_ -> .low.open_",
        ".user.open_ -> .top",
        ".user.open_ -> .user",
        ".user.top -> .top",
        ".user.top -> .user",
    ],
    "circles": [
        ".a -> .",
        ".a.name -> .a",
        ".a.name -> .a.name",
        ".a.name -> .b",
        ".a.spare -> .a",
        ".b -> .",
        ".b.*circles§.c -> .b",
        ".b.*circles§.c -> .c",
        ".b.name -> .b",
        ".b.name -> .b.*circles§.c",
        ".b.spare -> .b",
        ".b.spare -> .b.*circles§.c",
        ".c -> .",
        ".c.*circles§.d -> .c",
        ".c.*circles§.d -> .d",
        ".c.name -> .c",
        ".c.name -> .c.*circles§.d",
        ".c.spare -> .c",
        ".c.spare -> .c.*circles§.d",
        ".d -> .",
        ".d.*circles§.a -> .a",
        ".d.*circles§.a -> .d",
        ".d.name -> .d",
        ".d.name -> .d.*circles§.a",
        ".d.spare -> .d",
        ".d.spare -> .d.*circles§.a",
    ],
    "ring": [
        ".far -> .",
        ".far.*ring§.left -> .far",
        ".far.*ring§.left -> .left",
        ".far.TWO -> .far",
        ".far.TWO -> .far.*ring§.left",
        ".far.Three -> .far",
        ".far.Three -> .far",
        ".far.Three -> .far.*ring§.left",
        ".far.one -> .far",
        ".far.one -> .far.*ring§.left",
        ".left -> .",
        ".left.*ring§.right -> .left",
        ".left.*ring§.right -> .right",
        ".left.TWO -> .left",
        ".left.TWO -> .left.*ring§.right",
        ".left.Three -> .left",
        ".left.Three -> .left.*ring§.right",
        ".left.one -> .left",
        ".left.one -> .left",
        ".left.one -> .left.*ring§.right",
        ".left.one -> .left.TWO",
        ".left.one -> .right",
        ".left.one -> .right.TWO",
        ".right -> .",
        ".right.*ring§.far -> .far",
        ".right.*ring§.far -> .right",
        ".right.TWO -> .right",
        ".right.TWO -> .right",
        ".right.TWO -> .right.*ring§.far",
        ".right.Three -> .right",
        ".right.Three -> .right.*ring§.far",
        ".right.one -> .right",
        ".right.one -> .right.*ring§.far",
    ],
    "itself": [
        ".x -> .",
        ".y -> .",
    ],
    "dynamic": [
        ".lib -> .",
        ".lib.run -> .lib",
        ".lib.sub -> .lib",
        ".m -> .",
        ".m -> .lib 2",
        ".m -> .m.importlib",
        ".m.f -> .lib 2",
        ".m.f -> .lib.run 2",
        ".m.f -> .m",
        ".m.importlib -> .m",
    ],
    "values": [
        ".far -> .",
        ".far.come -> .far",
        ".far.come -> .far.other",
        ".far.come -> .lib",
        ".far.come -> .lib.run",
        ".far.come -> .m",
        ".far.come -> .m.lib",
        ".far.other -> .far",
        ".far.other -> .m",
        ".far.other -> .m.lib",
        ".lib -> .",
        ".lib.run -> .lib",
        ".m -> .",
        ".m.go -> .lib",
        ".m.go -> .lib.run",
        ".m.go -> .m",
        ".m.go -> .m.lib",
        ".m.import_module -> .m",
        ".m.lib -> .lib 2",
        ".m.lib -> .m",
        ".m.lib -> .m.import_module",
    ],
    "stubs": [
        ".s -> .",
        ".s -> .",
        ".s.both -> .s",
        ".s.both -> .s",
        ".s.both -> .s.both",
        ".s.only -> .s",
    ],
    "outside": [
        ".m -> .",
        ".m.json -> .m",
        ".m.nowhere§ -> .m",
        ".m.thing -> .m",
    ],
    "notes": [
        ".book -> .",
        ".book -> .book.draw",
        ".book -> .lib",
        ".book -> .lib.draw",
        ".book.draw -> .book",
        ".book.draw -> .lib",
        ".book.draw -> .lib.draw",
        ".lib -> .",
        ".lib.draw -> .lib",
    ],
    "script": [
        ".m -> .",
        ".m.main -> .m",
        ".m.other -> .m",
        ".m.started -> .m",
        ".m.started -> .m.main",
    ],
    "tested": [
        ".conftest -> .",
        ".conftest._link -> .conftest",
        ".conftest._link -> .conftest.pytest",
        ".conftest.pytest -> .conftest",
        ".conftest.store§ -> .conftest",
        ".conftest.store§ -> .conftest.pytest",
        ".test_m -> .",
        ".test_m.TestTwo -> .conftest._link",
        ".test_m.TestTwo -> .test_m",
        ".test_m.helper -> .test_m",
        ".test_m.test_one -> .conftest.store§",
        ".test_m.test_one -> .test_m",
    ],
    "cases": [
        ".m -> .",
        ".m -> .m.setUpModule",
        ".m.First -> .m",
        ".m.First -> .m.unittest",
        ".m.Other -> .m",
        ".m.Second -> .m",
        ".m.Second -> .m.First",
        ".m.setUpModule -> .m",
        ".m.unittest -> .m",
    ],
    "hooked": [
        ".m -> .",
        ".m.Free -> .m",
        ".m.Leaf -> .m",
        ".m.Leaf -> .m.Root",
        ".m.Leaf2 -> .m",
        ".m.Leaf2 -> .m.Leaf",
        ".m.Root -> .m",
        ".m.Root -> .m.Leaf 4",
        ".m.Root -> .m.Leaf2 4",
    ],
    "patched": [
        ".lib -> .",
        ".lib.real -> .lib",
        ".m -> .",
        ".m.f -> .lib.real",
        ".m.f -> .m",
        ".m.f -> .m.patch",
        ".m.patch -> .m",
    ],
    "served": [
        ".m -> .",
        ".m.Flask -> .m",
        ".m.app -> .m",
        ".m.app -> .m.Flask",
        ".m.app -> .m.home",
        ".m.app -> .m.lost",
        ".m.free -> .m",
        ".m.home -> .m",
        ".m.home -> .m.app",
        ".m.lost -> .m",
        ".m.lost -> .m.app",
    ],
    "named": [
        ".m -> .",
        ".m.drop -> .m",
        ".m.keep -> .m",
    ],
}

NODES: dict[str, list[str]] = {
    "rebound": [
        ". module 1 0 0",
        ".m module 1 0 0",
        ".m.f function 1 0 0",
        ".m.f function 3 0 0",
        ".m.g function 8 0 0",
        ".m.value variable 5 4 0",
        ".m.value variable 7 4 0",
    ],
    "pinned": [
        ". module 1 0 0",
        ".a module 1 0 0",
        ".a.x variable 1 0 0",
        ".b module 1 0 0",
        ".m module 1 0 0",
        ".m.pinned§ import 1 7 16",
        ".m.pinned§ import 2 7 0",
        ".m.x import 3 22 16",
    ],
    "outside": [
        ". module 1 0 0",
        ".m module 1 0 0",
        ".m.json import 1 7 0",
        ".m.nowhere§ import 2 7 1",
        ".m.thing import 3 27 1",
    ],
    "notes": [
        ". module 1 0 0",
        ".book module 1 0 32",
        ".book.draw import 2 23 32",
        ".lib module 1 0 0",
        ".lib.draw function 1 0 0",
    ],
    "script": [
        ". module 1 0 0",
        ".m module 1 0 2",
        ".m.main function 1 0 0",
        ".m.other function 2 0 0",
        ".m.started variable 4 4 2",
    ],
    "tested": [
        ". module 1 0 0",
        ".conftest module 1 0 2",
        ".conftest._link function 5 0 514",
        ".conftest.pytest import 1 7 1",
        ".conftest.store§ function 3 0 514",
        ".test_m module 1 0 0",
        ".test_m.TestTwo class 2 0 256",
        ".test_m.helper function 4 0 0",
        ".test_m.test_one function 1 0 256",
    ],
    "cases": [
        ". module 1 0 0",
        ".m module 1 0 0",
        ".m.First class 2 0 256",
        ".m.Other class 4 0 0",
        ".m.Second class 3 0 256",
        ".m.setUpModule function 5 0 0",
        ".m.unittest import 1 7 0",
    ],
    "branches": [
        ". module 1 0 0",
        ".m module 1 0 0",
        ".m.OFF variable 2 0 0",
        ".m.TYPE_CHECKING import 1 19 0",
        ".m.f function 8 0 0",
        ".m.kind variable 7 4 0",
        ".m.used function 3 0 0",
    ],
    "named": [
        ". module 1 0 0",
        ".m module 1 0 2",
        ".m.drop function 2 0 2",
        ".m.keep function 1 0 2",
    ],
    "stubs": [
        ". module 1 0 0",
        ".s module 1 0 0",
        ".s module 1 0 0",
        ".s.both function 1 0 0",
        ".s.both function 1 0 0",
        ".s.only function 2 0 2",
    ],
}
