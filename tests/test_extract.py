"""Extractors on sources written for these tests."""

from stratalens.operators.languages import EXTRACTORS, imported_names, skeleton

PY = '''"""Module."""
import os.path as p
from shop.cart import Cart, Item as I


@register
class Basket(Cart, Generic[T]):
    """Holds items."""

    limit = 3

    def __init__(self, owner: str = "a)b"):
        self.owner = owner

    @property
    async def total(self) -> int:
        """Sum of prices."""
        def helper():
            pass
        return 1

    class Line:
        def price(self): ...


if True:
    def top(x, *, y=(1, 2)):
        return x
'''


def by_name(language, text, module="m"):
    return {s["qualified_name"]: s for s in EXTRACTORS[language](text, module)}


def test_python():
    s = by_name("python", PY, "shop.basket")
    assert list(s) == [f"shop.basket.{n}" for n in ("Basket", "Basket.__init__", "Basket.total", "Basket.Line", "Basket.Line.price", "top")]
    basket = s["shop.basket.Basket"]
    assert (basket["kind"], basket["signature"], basket["start_line"], basket["end_line"], basket["docstring"]) == ("class", "class Basket(Cart, Generic[T])", 6, 23, "Holds items.")
    assert s["shop.basket.Basket.__init__"]["kind"] == "constructor"
    assert s["shop.basket.Basket.__init__"]["signature"] == 'def __init__(self, owner: str = "a)b")'
    total = s["shop.basket.Basket.total"]
    assert (total["kind"], total["signature"], total["start_line"], total["docstring"]) == ("method", "async def total(self)", 15, "Sum of prices.")
    assert s["shop.basket.top"]["kind"] == "function" and s["shop.basket.top"]["signature"] == "def top(x, *, y=(1, 2))"


def test_python_with_syntax_error():
    s = by_name("python", "class A(B):\n    '''Doc.'''\n    def f(self):\n        x = = 1\n\ndef g(a): pass\n")
    assert [(x["qualified_name"], x["kind"], x["start_line"], x["end_line"]) for x in s.values()] == [("m.A", "class", 1, 4), ("m.A.f", "method", 3, 4), ("m.g", "function", 6, 6)]
    assert s["m.A"]["docstring"] == "Doc."


def test_python_imports_and_skeleton():
    assert imported_names("python", PY) == [("os.path", None), ("shop.cart", "Cart"), ("shop.cart", "Item")]
    assert skeleton("python", "class A:\n    x = 1\n    def f(self):\n        return 1\n    y = 2", "class") == "class A:\n    x = 1\n    def f(self):\n        ...\n    y = 2"
    assert skeleton("python", "def f(): pass", "function") == "def f(): pass"


GO = """// Package comment.
package store

import "example.org/app/auth"

// Limit is the most.
const Limit = 3

// Box holds values
// of one kind.
//go:noinline
type Box[T any] struct {
	items []T
}

type (
	Reader interface{ Read() error }
	ID     int
	Alias  = string
)

// Put adds one.
func (b *Box[T]) Put(v T) interface{} {
	if v != nil { return "}" }
	return nil
}

func New(n int) (*Box[int], error) { return nil, nil }
"""


def test_go():
    s = by_name("go", GO)
    assert list(s) == ["store.Box", "store.Reader", "store.ID", "store.Box.Put", "store.New"]
    assert (s["store.Box"]["kind"], s["store.Box"]["docstring"], s["store.Box"]["start_line"], s["store.Box"]["end_line"]) == ("struct", "Box holds values of one kind.", 12, 14)
    assert [s[f"store.{n}"]["kind"] for n in ("Reader", "ID")] == ["interface", "struct"]
    assert (s["store.ID"]["start_line"], s["store.ID"]["end_line"], s["store.ID"]["signature"]) == (16, 20, "type ID struct")
    put = s["store.Box.Put"]
    assert (put["signature"], put["kind"], put["docstring"], put["start_line"], put["end_line"]) == ("func (b *Box[T]) Put(v T)", "method", "Put adds one.", 23, 26)
    assert s["store.New"]["signature"] == "func New(n int)"
    assert imported_names("go", GO) == [("auth", None)]


JAVA = """package org.shop;

import java.util.List;
import static org.util.Tools.*;

/** A basket
 *  of things. */
@Entity(name = "b")
public final class Basket<T extends Item> extends base.Cart<T> implements Sized, Comparable<Basket<T>> {
    private final List<T> items = new ArrayList<>();
    static { init(); }

    /** Makes one. */
    public Basket(int n) { this.n = n; }

    @Override
    public <R> Map<String, R> group(Function<T, R> f, int[] xs) throws IOException {
        return "}".isEmpty() ? null : null;
    }
    abstract int size();

    // no doc
    interface View extends A, B { void show(); }
    enum Color { /** Warm. */ RED(1), GREEN { int x() { return 1; } }; int y() { return 2; } }
    record Point(int x, int y) implements A { Point { } }
}
"""


def test_java():
    s = by_name("java", JAVA)
    assert list(s) == [f"org.shop.Basket{n}" for n in ("", ".Basket", ".group", ".size", ".View", ".View.show", ".Color", ".Color.RED", ".Color.GREEN", ".Color.y", ".Point")]
    b = s["org.shop.Basket"]
    assert (b["signature"], b["docstring"], b["start_line"]) == ("class Basket extends base.Cart<T> implements Sized, Comparable<Basket<T>>", "A basket of things.", 8)
    assert (s["org.shop.Basket.Basket"]["kind"], s["org.shop.Basket.Basket"]["signature"], s["org.shop.Basket.Basket"]["docstring"]) == ("constructor", "Basket(int n)", "Makes one.")
    assert s["org.shop.Basket.group"]["signature"] == "Map<String, R> group(Function<T, R> f, int[] xs)"
    assert (s["org.shop.Basket.group"]["start_line"], s["org.shop.Basket.group"]["end_line"]) == (16, 19)
    assert s["org.shop.Basket.View"]["signature"] == "interface View extends A, B" and s["org.shop.Basket.View"]["docstring"] is None
    assert (s["org.shop.Basket.Color.RED"]["kind"], s["org.shop.Basket.Color.RED"]["docstring"]) == ("enum_constant", "Warm.")
    assert s["org.shop.Basket.Point"]["signature"] == "record Point(int x, int y)"
    assert imported_names("java", JAVA) == [("java.util.List", None), ("org.util.Tools", None)]


KOTLIN = """package org.shop

import java.util.Date

/** A basket. */
data class Basket(val owner: String, val n: Int = 1) : Cart(owner), Sized {
    companion object {
        const val MAX: Int = 3
    }
    private val items: List<Item> = listOf()
    var hint: String? = null
    init { println("}") }
    /** Adds. */
    fun add(item: Item): Basket {
        val local = 1
        return this
    }
    class Line
}

interface Sized { fun size(): Int }
enum class Color { RED, GREEN; fun warm() = this == RED }
object Registry { fun get(id: Int) = null }
fun String.shout(): String = uppercase()
"""


def test_kotlin():
    s = by_name("kotlin", KOTLIN)
    b = "org.shop.Basket"
    assert list(s) == [b, f"{b}.Companion", f"{b}.Companion.MAX", f"{b}.items", f"{b}.hint", f"{b}.add", f"{b}.Line"] + [
        f"org.shop.{n}" for n in ("Sized", "Sized.size", "Color", "Color.RED", "Color.GREEN", "Color.warm", "Registry", "Registry.get", "shout")
    ]
    assert s[b]["signature"] == "data class Basket(val owner: String, val n: Int = 1) : Cart(owner), Sized" and s[b]["docstring"] == "A basket."
    assert (s[f"{b}.Companion.MAX"]["kind"], s[f"{b}.Companion.MAX"]["signature"]) == ("constant", "const val MAX: Int")
    assert s[f"{b}.items"]["signature"] == "private val items: List<Item>" and s[f"{b}.hint"]["signature"] == "var hint"
    assert (s[f"{b}.add"]["kind"], s[f"{b}.add"]["signature"], s[f"{b}.add"]["docstring"]) == ("method", "fun add(item: Item): Basket", "Adds.")
    assert [s[f"org.shop.{n}"]["kind"] for n in ("Sized", "Color", "Color.RED", "Registry", "shout")] == ["interface", "enum", "enum_constant", "class", "function"]
    assert s["org.shop.shout"]["signature"] == "fun String.shout(): String"
    assert s["org.shop.Color"]["signature"] == "enum class Color"


GLEAM = """import gleam/io

/// Greets a person.
pub fn greet(name: String, f: fn(Int) -> Int) -> String {
  "Hi " <> name
}

fn hidden() { Nil }

pub type Mood {
  Happy
  Sad
}

pub type Name = String

const limit = 3
"""


def test_gleam():
    s = by_name("gleam", GLEAM, "app/greet")
    assert [(x["name"], x["kind"], x["signature"], x["start_line"], x["end_line"]) for x in s.values()] == [
        ("greet", "function", "pub fn greet(name: String, f: fn(Int) -> Int) -> String", 4, 6),
        ("hidden", "function", "fn hidden()", 8, 8),
        ("Mood", "enum", "pub type Mood", 10, 13),
        ("Name", "type_alias", "pub type Name", 15, 15),
        ("limit", "constant", "const limit", 17, 17),
    ]
    assert s["app/greet.greet"]["docstring"] == "Greets a person."


ERLANG = """-module(greet).
-type mood() :: happy | sad.
-record(person, {name, age}).

%% @doc Greets.
greet(happy) ->
    case 1 of 1 -> a; _ -> b end;
greet(_) -> "x. y".

area({square, S}) -> S * S.
"""


def test_erlang():
    s = by_name("erlang", ERLANG, "greet")
    assert [(x["name"], x["kind"], x["signature"], x["start_line"], x["end_line"]) for x in s.values()] == [
        ("mood", "type_alias", "-type mood()", 2, 2),
        ("person", "record", "-record(person, ...)", 3, 3),
        ("greet", "function", "greet(happy)", 6, 7),
        ("area", "function", "area({square, S})", 10, 10),
    ]
    assert s["greet.greet"]["docstring"] == "Greets."


def test_extractors_survive_garbage():
    for language, extract in EXTRACTORS.items():
        for text in ("", "}}}{{{", "((((", "class", "func (", "'\"`", "\x00é", "fun <T", "type X", "@", "-record(", "enum class E {", "package"):
            assert isinstance(extract(text, "m"), list), (language, text)
