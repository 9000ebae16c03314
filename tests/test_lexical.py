from graphloom.sources import lexical, python_code

TS = {
    "lib/fees/late.ts": 'import { Loan } from "../loan";\n\n// @deprecated see overdue\nexport const late = (x: Loan, today: number) => (today > x.due ? today - x.due : 0);\n\nexport const check = () => hidden(1);\n',
    "lib/desk.spec.ts": 'import { settle } from "./desk";\n\nit("settles", () => {\n  expect(settle([], 3)).toBe(0);\n});\n',
    "lib/desk.ts": """import { late } from "./fees/late";
import type { Loan } from "./loan";

/* What a reader owes. */
export async function settle(loans: Loan[], today: number): Promise<number> {
  let owed = 0;
  while (loans.length) {
    const x = loans.pop();
    if (x && x.due < today || today < 0) {
      try {
        owed += late(x, today); // "if" here is no branch
      } catch (e) {
        return -1;
      }
    }
  }
  return owed;
}

function hidden(n: number): number {
  return n;
}

export abstract class Desk {
  protected open = true;

  async lend(x: Loan): Promise<void> {
    await settle([x], 0);
  }

  protected shut() {}
}

function shelf(kind: string): string {
  if (kind === "a") {
    return "x";
  } else if (kind === "b") {
    return "y";
  } else {
    return "z";
  }
}

export { shelf };
""",
    "lib/loan.ts": "export type Loan = {\n  due: number;\n};\n\nexport enum State {\n  Out,\n  In,\n}\n\nexport const DAYS = 30;\nlet counter = 0;\n",
}
RS = {
    "src/fees.rs": "/// Old.\n#[deprecated(note = \"x\")]\npub(crate) fn late(due: u32, today: u32) -> Option<u32> {\n    match today.checked_sub(due) {\n        Some(n) => Some(n),\n        None => None,\n    }\n}\n\nuse std::collections::HashMap;\n",
    "src/main.rs": """mod fees;

use crate::fees::late;

pub trait Shelf {
    fn put(&self, n: u32);
}

pub enum State {
    Out,
    In,
}

pub fn settle(dues: &[u32], today: u32) -> u32 {
    let mut owed = 0;
    for d in dues {
        while *d > 0 || today == 0 {
            if let Some(n) = late(*d, today) {
                owed += n;
            }
        }
    }
    owed
}

impl Shelf for State {
    fn put(&self, n: u32) {
        settle(&[n], 0);
    }
}

impl<T> Desk<T> {
    fn shut(&mut self, why: Option<(u32, u32)>) {}
}

const DAYS: u32 = 30;

#[cfg(test)]
mod checks {
    use super::*;

    #[test]
    fn settles() {
        assert_eq!(settle(&[], 1), 0);
    }
}
""",
}


def linked(spark, files, module, language):
    found = lexical.extract(spark.createDataFrame(list(files.items()), "path string, text string"), module, language).persist()
    d, e, i = python_code.link(found)
    return {r.id: r for r in d.collect()}, {(r.src, r.dst, r.kind) for r in e.collect()}, {tuple(r) for r in i.collect()}


def test_typescript(spark):
    d, e, imports = linked(spark, TS, "app", "typescript")
    s = d["app/lib.settle"]
    assert (s.kind, s.exported, s.start_line, s.end_line, s.complexity, s.nesting, s.params) == ("func", True, 4, 18, 6, 3, 2)
    assert s.signature == "(loans: Loan[], today: number): Promise<number>" and s.lines == 14
    assert (d["app/lib.shelf"].exported, d["app/lib.shelf"].complexity, d["app/lib.shelf"].nesting) == (True, 3, 1) and not d["app/lib.hidden"].exported
    assert {k: (d[k].kind, d[k].exported) for k in d if "Desk" in k} == {"app/lib.Desk": ("type", True), "app/lib.Desk.lend": ("method", True), "app/lib.Desk.shut": ("method", False)}
    assert [d[f"app/lib.{n}"].kind for n in ("Loan", "State", "DAYS", "counter")] == ["type", "type", "const", "var"]
    late = d["app/lib/fees.late"]
    assert (late.kind, late.deprecated, late.start_line, late.complexity, late.params) == ("func", True, 3, 2, 2)
    callers = lambda x: {s for s, t, k in e if t == x and k == "caller"}
    assert callers("app/lib.settle") == {"app/lib.Desk.lend"} and callers("app/lib/fees.late") == {"app/lib.settle"} and callers("app/lib.hidden") == set()
    assert ("app/lib/fees.late", "app/lib.Loan", "user") in e and ("app/lib.Desk.lend", "app/lib.Loan", "user") in e
    assert imports == {("app/lib", "app/lib/fees"), ("app/lib/fees", "app/lib")}


def test_rust(spark):
    d, e, imports = linked(spark, RS, "app", "rust")
    s = d["crate.settle"]
    assert (s.kind, s.exported, s.test, s.start_line, s.end_line, s.complexity, s.nesting, s.params) == ("func", True, False, 14, 24, 5, 3, 2)
    assert d["crate.State"].kind == "type" and d["crate.State.put"].kind == "method" and d["crate.State.put"].exported and d["crate.State.put"].params == 1
    assert not d["crate.Desk.shut"].exported and d["crate.Desk.shut"].params == 1 and d["crate.DAYS"].kind == "const" and d["crate.settles"].test
    late = d["crate::fees.late"]
    assert (late.exported, late.deprecated, late.start_line, late.complexity, late.params) == (True, True, 1, 2, 2)
    callers = lambda x: {s for s, t, k in e if t == x and k == "caller"}
    assert callers("crate.settle") == {"crate.State.put", "crate.settles"} and callers("crate::fees.late") == {"crate.settle"}
    assert imports == {("crate", "crate::fees")}
