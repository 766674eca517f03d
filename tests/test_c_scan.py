import pytest

from pairloom.functions.c_scan import scan_functions


def names(text, cpp=True):
    return [n for n, _ in scan_functions(text, cpp)[0]]


@pytest.mark.parametrize("text, expected", [
    ("int f(void) { return 1; }", ["f"]),
    ("static inline unsigned long g(int a, char *b) { if (a) { h(); } return 0; }", ["g"]),
    ("char *p(void) { return 0; }", []),
    ("int f(void);", []),
    ("struct s { int a; }; int f(struct s *x) { return x->a; }", ["f"]),
    ("struct s f(int a) { struct s r = {1, {2}}; return r; }", ["f"]),
    ("int a[] = { 1, 2 }; int f() { int b[] = {1}; }", ["f"]),
    ("#define M(x) { x\nint f(void) { M(1) }", ["f"]),
    ("#if A\nint f(void) { }\n#else\nint g(void) { }\n#endif", ["f", "g"]),
    ("// int no(void) { }\n/* int no2(void) { } */ int f(void) { char *s = \"} {\"; char c = '}'; }", ["f"]),
    ("int (*fp(int a))(char) { return 0; }", []),
    ("int __attribute__((noinline)) f(void) { }", ["f"]),
    ("void f(void) { for (int i = 0; i < 3; i++) { } while (x) { } switch (y) { case 1: { } } }", ["f"]),
    ("int f(void) { FOREACH(x) { } return 0; }", ["f"]),
    ("enum e { A, B }; typedef struct { int x; } t; int f(t a) { }", ["f"]),
])
def test_c(text, expected):
    assert names(text, cpp=False) == expected


@pytest.mark.parametrize("text, expected", [
    ("int A::f(int x) const { return x; }", ["f"]),
    ("int A::B::f() { }", []),
    ("int &f() { }", ["f"]),
    ("A::A() : a_(1), b_{2} { init(); }", ["A"]),
    ("A::~A() { }", []),
    ("bool A::operator==(const A &o) const { return true; }", []),
    ("A::operator bool() const { return true; }", []),
    ("template <class T> T max(T a, T b) { return a; }", ["max"]),
    ("int f<int>(int x) { }", []),
    ("class X : public Y { public: int get() const { return v; } X(int a) : v(a) { } private: int v; };",
     ["get", "X"]),
    ("namespace n { inline int f() { auto l = [](int q) { return q; }; return l(1); } }", ["f"]),
    ('extern "C" { int f() { } }', ["f"]),
    ('extern "C" int g() { return 0; }', ["g"]),
    ("struct S { S() = default; S(const S&) = delete; };", ["S", "S"]),
    ("auto f(int a) -> int { return a; }", ["f"]),
    ("Foo<T>::bar() { }", ["bar"]),
    ("int f() noexcept(true) { } int g() override { }", ["f", "g"]),
    ("int f() { struct L { int m() { return 1; } }; return 0; }", ["f", "m"]),
    ('const char *s = R"x(int no() { })x"; int f() { }', ["f"]),
    ("int n = 1'000'000; int f() { return 2'0; }", ["f"]),
])
def test_cpp(text, expected):
    assert names(text) == expected


def test_text_is_exact():
    text = 'template <class T>\nstatic T f(T a) /* c */ {\n  g("}");\n}\nextern "C" int h() { }'
    assert scan_functions(text, True)[0] == [
        ("f", 'static T f(T a) /* c */ {\n  g("}");\n}'), ("h", "int h() { }")
    ]


def test_order_is_by_start_even_when_nested():
    assert names("int f() { struct L { int m() { } }; } int z() { }") == ["f", "m", "z"]


def test_unbalanced_is_reported_and_the_rest_kept():
    functions, problem = scan_functions("int f() { }\nint g() { {", True)
    assert [n for n, _ in functions] == ["f"] and problem == "unbalanced_braces"
    functions, problem = scan_functions("}\nint g() { }", False)
    assert [n for n, _ in functions] == ["g"] and problem == "unbalanced_braces"


@pytest.mark.parametrize("shape", [
    "int a[][2] = {{{0}}};", "int a[][2]{{{{{0}}}}};", "int f(void) {{ static T t[] = {{{0}}}; g({{{0}}}); }}",
    "T t = make({0}); int g(void) {{ }}",
])
def test_long_tables_stay_linear(shape):
    import time

    def seconds(entries):
        text = shape.format("{1, 2}, " * entries)
        start = time.perf_counter()
        scan_functions(text, True)
        return time.perf_counter() - start

    seconds(1_000)
    assert min(seconds(64_000) for _ in range(3)) < 12 * max(min(seconds(16_000) for _ in range(3)), 0.02)


def test_function_after_a_table():
    text = "static const int t[] = { {1, 2}, {3, 4} };\nint f(void) { int b[] = { g({1}), {2} }; return b[0]; }\nint h(void) { }"
    assert names(text, cpp=False) == ["f", "h"]
    assert scan_functions(text, False)[0][0][1] == "int f(void) { int b[] = { g({1}), {2} }; return b[0]; }"


@pytest.mark.parametrize("text, expected", [
    ("int f() try { g(); } catch (int a) { h(); } catch (...) { }\nint k() { }",
     [("f", "int f() try { g(); } catch (int a) { h(); } catch (...) { }"), ("k", "int k() { }")]),
    ("A::A(int x) try : b_(x) { } catch (...) { throw; }", [("A", "A::A(int x) try : b_(x) { } catch (...) { throw; }")]),
    ("int f() { try { } catch (...) { } }", [("f", "int f() { try { } catch (...) { } }")]),
])
def test_function_try_block_is_whole(text, expected):
    assert scan_functions(text, True)[0] == expected


def test_long_inputs_stay_linear():
    text = "".join(f"int f{i}(int a) {{ if (a) {{ g({i}); }} return \"{{\"; }}\n" for i in range(5000))
    assert len(scan_functions(text, True)[0]) == 5000
    assert scan_functions("int a[] = {" + "{1, 2}, " * 20000 + "};", True) == ([], None)
