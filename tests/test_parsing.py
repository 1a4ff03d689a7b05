"""Definitions by language, on small sources about a harbour, a kitchen and a library; expectations follow the kinds that each language has."""

import textwrap

import pytest

from lodestone.parsing.objects import parse


def found(path, text):
    """The file row, and (kind, name) of each definition in order."""
    rows = parse(path, textwrap.dedent(text).lstrip("\n").encode())
    assert (rows[0]["kind"], rows[0]["name"]) == ("file", path)
    return rows, [(r["kind"].removeprefix("definition."), r["name"]) for r in rows[1:]]


def rows_of(row):
    return row["coordinates"]["start"]["row"], row["coordinates"]["end"]["row"]


@pytest.mark.parametrize("suffix", ["js", "mjs", "cjs", "jsx", "ts", "tsx"])
def test_script_values(suffix):
    rows, got = found(f"berths.{suffix}", """
        export const limit = 12, spare = limit / 2; // not { a block
        var tides = ["low", /[}]\\/high/],
            slack = `half ${ tides.map(t => { return t; }) } done`;
        let keeper = null;
        const moor = async boat => { await boat; };
        export default function* round() { yield "}"; }
        keeper.log = function (line) { print(line); };
        if (limit) { var inner = 3; const hidden = 4; }
    """)
    assert [x for x in got if x[1] in ("limit", "tides", "keeper")] == [("constant", "limit"), ("constant", "tides"), ("constant", "keeper")]
    assert ("function", "moor") in got and ("function", "round") in got and ("function", "log") in got
    assert ("constant", "hidden") not in got and ("constant", "moor") not in got
    assert rows[0]["coordinates"]["end"]["row"] == 8


def test_script_members():
    rows, got = found("ferry.js", """
        // the ferry
        class Ferry extends Boat {
          #deck = { cars: () => 4 };
          get length() { return 80; }
          static build(yard) {
            return yard.next();
          }
        }
        const Tug = class { pull() { } };
        Harbour.open = () => true;
        const table = { fill: function () { }, drain: () => { }, size: 3 };
    """)
    assert [x for x in got if x[0] == "class"][0] == ("class", "Ferry")
    assert {("method", "length"), ("method", "build"), ("method", "pull"), ("function", "open"), ("function", "fill"), ("function", "drain")} <= set(got)
    assert ("function", "size") not in got
    build = rows[1 + got.index(("method", "build"))]
    assert rows_of(build) == (4, 6) and build["context_before"] == [1] and build["context_after"] == [7]


def test_type_script_declarations():
    _, got = found("pilot.ts", """
        namespace Port { export interface Pilot { board(ship: string): boolean; } }
        declare function hail(name: string): void;
        export abstract class Crew<T> {
          abstract roster(): T[];
          protected rest(hours: number): void { }
        }
    """)
    assert {("interface", "Pilot"), ("method", "board"), ("function", "hail"), ("class", "Crew"), ("method", "roster"), ("method", "rest")} <= set(got)


def test_c_source():
    rows, got = found("oven.c", """
        #include "oven.h"
        struct tray { int slots; };
        union heat { int low; double high; } now;
        enum mode { BAKE, GRILL = 3 };
        typedef unsigned long seconds_t;
        /* static int old(void) { return 1; } */
        static seconds_t
        bake(struct tray *t, int n)
        {
            while (n--) { t->slots += '{'; }
            return 0;
        }
        int stop(void);
    """)
    assert got == [("struct", "tray"), ("class", "heat"), ("type", "mode"), ("type", "seconds_t"), ("function", "bake")]
    assert rows_of(rows[5]) == (6, 11) and {r["language"] for r in rows} == {"c"}


def test_header_is_read_as_the_wider_language():
    rows, got = found("pantry.h", """
        #ifndef PANTRY
        typedef enum { DRY, COLD } shelf;
        class Jar {
          public:
            explicit Jar(int grams);
            int weigh() const;
        };
        int count(const Jar& j);
        #endif
    """)
    assert {r["language"] for r in rows} == {"cpp"}
    assert got == [("type", "shelf"), ("class", "Jar"), ("method", "weigh")]
    # the guard around everything gives its first and last rows to what is inside
    assert rows[2]["context_before"][0] == 0 and rows[3]["context_before"] == [0, 2] and rows[3]["context_after"] == [8, 6]


def test_cpp_source():
    _, got = found("stove.cpp", """
        namespace kitchen {
        template <typename T> struct Ring { T first; };
        int Stove::light(int ring) { return ring ? 1 : 0; }
        static void wipe() { auto f = [](int x) { return x; }; f(2); }
        }
        union Flame { char c; } flame;
    """)
    assert {("struct", "Ring"), ("method", "light"), ("function", "wipe"), ("class", "Flame")} <= set(got)


def test_rust_items():
    rows, got = found("shelf.rs", """
        mod index {
            pub type Key = u64;
            pub enum Slot { Free, Taken(Key) }
        }
        union Raw { n: u32 }
        struct Shelf<'a> { name: &'a str }
        trait Borrow { fn lend(&mut self) -> bool; }
        impl Raw {
            // keeps '}' out
            fn label(&self) -> char { '}' }
        }
        impl Borrow for Raw {
            fn lend(&mut self) -> bool { r#"{"#.len() > 0 }
        }
        macro_rules! card { () => { 1 }; }
    """)
    assert got == [
        ("module", "index"), ("class", "Key"), ("class", "Slot"), ("class", "Raw"), ("struct", "Shelf"), ("interface", "Borrow"),
        ("struct.impl", "Raw"), ("function", "label"), ("trait.impl", "Borrow"), ("function", "lend"), ("macro", "card"),
    ]
    label = rows[1 + got.index(("function", "label"))]
    assert label["context_before"] == [7] and label["context_after"] == [10]


PYTHON = """
import os

SHELVES = {"a": 1}
first, second = 1, 2


class Reader:
    limit = 3

    @property
    def card(self):
        return "def nothing(): pass"

    async def borrow(self, title): ...


def close(): return [x for x in SHELVES]
"""


@pytest.mark.parametrize("tail", ["", "while True print(\n"])
def test_python(tail):
    rows, got = found("reader.py", PYTHON + tail)
    assert got[0] == ("constant", "SHELVES") and {("class", "Reader"), ("function", "card"), ("function", "borrow"), ("function", "close")} <= set(got)
    assert ("constant", "limit") not in got
    borrow, close = (rows[1 + got.index(("function", n))] for n in ("borrow", "close"))
    assert borrow["context_before"] == [6] and borrow["context_after"] == [] and close["context_before"] == []


def test_csharp():
    rows, got = found("Desk.cs", """
        namespace Front
        {
            // interface Ghost { }
            interface IDesk { bool Open(); }
            public sealed class Desk : IDesk
            {
                public string Sign => "{ closed }";
                public Desk() { }
                [Obsolete("later")]
                public bool Open() { if (Sign == null) { return false; } return true; }
            }
        }
    """)
    assert [k for k, _ in got] == ["module", "interface", "method", "class", "method"]
    assert got[1][1] == "IDesk" and got[3][1] == "Desk" and got[4][1] == "Open"
    assert rows[5]["context_before"] == [0, 4] and rows[5]["context_after"] == [11, 10]


def test_go():
    rows, got = found("loan.go", """
        package loan

        type (
            Days int
            Loan struct{ due Days }
        )

        type Lender interface{ Lend(title string) error }

        func (l *Loan) Extend(by Days) { l.due += by }

        func sum(all ...Days) (n Days) {
            for _, d := range all { n += d; _ = `}` }
            return
        }
    """)
    assert [x for x in got if x[0] != "type"] == [("method", "Extend"), ("function", "sum")] and ("type", "Lender") in got
    assert rows_of(rows[-1]) == (11, 14)


def test_java():
    rows, got = found("Crane.java", """
        package port;

        interface Lifts {
            void lift(int tons) throws Overload;
        }

        abstract class Crane implements Lifts {
            private final String note = "class Fake { }";

            Crane() { super(); }

            @Override
            public void lift(int tons) {
                new Thread(() -> { }).start();
            }
        }
    """)
    assert ("interface", "Lifts") in got and ("class", "Crane") in got and got.count(("method", "lift")) == 2 and ("class", "Fake") not in got
    assert rows[-1]["context_before"] == [6] and rows[-1]["context_after"] == [15]


def test_ruby():
    rows, got = found("lamp.rb", """
        module Light
          class Lamp < Base
            def glow?(on = true)
              return false unless on
              while on do on = step end
              "the end"
            end

            def self.make; new end
            alias shine glow?

            class << self
              def count = 3
            end
          end
        end
        def dim(x) x end
    """)
    assert got[:3] == [("module", "Light"), ("class", "Lamp"), ("method", "glow?")]
    assert ("method", "make") in got and ("method", "shine") in got and got[-1] == ("method", "dim")
    assert rows_of(rows[3]) == (2, 6) and rows[3]["context_before"] == [0, 1] and rows[3]["context_after"] == [15, 14]


def test_php():
    rows, got = found("menu.php", """
        <?php
        namespace Kitchen\\\\Menu;
        interface Priced { public function price(): int; }
        trait Named { private string $name = "function no() {}"; }
        final class Dish implements Priced {
            use Named;
            protected ?int $cents;
            public function price(): int { return $this->cents ?? 0; }
        }
        function serve(Dish ...$all) { foreach ($all as $d) { echo $d->price(); } }
    """)
    assert ("interface", "Priced") in got and ("interface", "Named") in got and ("class", "Dish") in got
    assert ("field", "name") in got and ("field", "cents") in got and got.count(("method", "price")) == 2 and got[-1] == ("function", "serve")
    assert any(k == "module" for k, _ in got) and any(k == "class_interface_clause" for k, _ in got)
    cents = rows[1 + got.index(("field", "cents"))]
    assert cents["context_before"] == [4] and cents["context_after"] == [8]


def test_minified_scripts_take_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        parse("m.js", ("a=function(){b={c:[1,2,(3)]};d.e=function(){return f}};" * n).encode())
        return time.perf_counter() - began

    took(50)
    assert took(1600) < 24 * max(took(200), 0.02)


@pytest.mark.parametrize("path", ["notes.txt", "LICENSE", "upper.PY", ".rs"])
def test_other_files_are_one_object(path):
    rows, got = found(path, "fn shelf() {}\nabc")
    assert got == [] and rows[0]["language"] == "text" and rows[0]["coordinates"]["end"] == {"row": 1, "col": 3}


@pytest.mark.parametrize("path", ["a.py", "a.js", "a.ts", "a.c", "a.h", "a.rs", "a.go", "a.java", "a.cs", "a.php", "a.rb"])
@pytest.mark.parametrize("text", [b"", b")]}{[(", b"{{ struct", b'"open', b"\xfe\xffinterface Y {", b"interface", b"fn", b"def (", b"trait", b"${`", b"// \\", b"\r\nclass A {\r\n"])
def test_broken_sources_never_fail(path, text):
    rows = parse(path, text)
    assert rows[0]["kind"] == "file" and all(0 <= r["byte_range"]["start"] <= r["byte_range"]["end"] <= len(text) for r in rows)
