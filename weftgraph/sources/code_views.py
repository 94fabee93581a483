"""Source files written from the supplier and order tables.

Every supplier gets one small service file per language and every order one
client file, so what extraction must find follows from the tables: the oracle
never reads a line of code. ``@S@`` is the supplier number, ``@N@`` its nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources import views

SERVICE_FILES = {
    "python": ("app/supplier_@S@.py", '''import requests
from shared.auth import check_token

class SupplierStore@S@(Base):
    def load_part(self, part):
        """Load one part."""
        return requests.get(f"https://stock-@N@.internal/v1/suppliers/@S@/parts/{part}?full=1")

@app.post("/api/v1/suppliers/@S@/orders")
def place_order_@S@(order):
    store = SupplierStore@S@()
    return store.load_part(order)

def total_@S@(lines):
    return sum(lines)
'''),
    "broken_python": ("broken/supplier_@S@.py", '''def broken_@S@(x):
    return {
class Late@S@
    pass
'''),
    "ts": ("web/supplier_@S@.ts", '''import { api } from '@acme/api';
export interface Order@S@ {
  id: number;
}
export async function loadOrder@S@(id: number) {
  if (id) { return null; }
  return fetch(`https://gw.internal/api/v1/suppliers/@S@/orders?id=1`, { method: 'POST' });
}
const total@S@ = (xs: number[]): number => {
  return xs.length;
};
class Box {
  open(lid: string): void {
    axios.put("/v2/boxes/@S@", lid);
  }
}
'''),
    "go": ("cmd/supplier_@S@.go", '''package main
import (
  "fmt"
  "net/http"
)
type Server@S@ struct {
  name string
}
// @Router /api/v1/suppliers/@S@/health [get]
func (s *Server@S@) Health(w http.ResponseWriter) {
  fmt.Println("ok")
}
func Sync@S@() {
  http.Post("http://stock-@N@.internal/v1/sync/@S@", "x", nil)
}
func Routes@S@(r *gin.Engine) {
  r.DELETE("/v1/suppliers/@S@", drop)
}
'''),
    "java": ("src/Supplier@S@.java", '''@RequestMapping("/api/v1/suppliers/@S@/")
public class SupplierApi@S@ {
  private int a;
  @GetMapping(value = "/parts")
  public List<Part> listParts@S@(String q) {
    return repo.find(q);
  }
  private int b;
  private int c;
  public void helper@S@(int x) {
    if (x > 0) { return; }
  }
}
'''),
    "php": ("php/supplier_@S@.php", '''<?php
use Illuminate;
Route::get('/v1/suppliers/@S@/list', 'x');
final class Supplier@S@ {
  public static function push@S@($c) {
    return Http::post('https://pdf.internal/v1/render/@S@?x=1', $c);
  }
}
'''),
    "rust": ("rs/supplier_@S@.rs", '''use std::collections;
pub struct Store@S@ {
    n: u32,
}
#[get("/api/v1/suppliers/@S@/stock")]
pub async fn stock@S@(id: u32) -> u32 {
    client.put("https://wh.internal/v1/stock/@S@")
}
// a
// b
// c
fn tail@S@() { }
'''),
    "csharp": ("cs/Supplier@S@.cs", '''using System.Net;
public class Shop@S@ {
  [HttpPut("/api/v1/shops/@S@")]
  public async Task<int> Save@S@(string id) {
    await http.DeleteAsync("/v1/carts/@S@");
  }
  int a;
  int b;
  int c;
  public void Noop@S@(int k) {
  }
}
'''),
    "ruby": ("rb/supplier_@S@.rb", '''require 'json'
module Shop@S@
  class Store@S@
    def push@S@(order)
      if order
        Faraday.post("https://pay.internal/v1/charge/@S@", order)
      end
    end
  end
end
get '/v1/shop/@S@' do
  render
end
'''),
    "c": ("cpp/supplier_@S@.cpp", '''#include <stdio.h>
#include "shop.h"
class Shop@S@ : public Base {
  int n;
};
int Shop@S@::count@S@(int a) {
  return a;
}
int proto@S@(int a);
static void fill@S@(int b)
{
  n = b;
}
'''),
    "clojure": ("clj/supplier_@S@.clj", '''(ns shop.s@S@)
(defn fetch-part@S@ [id]
  (client/get "https://inv.internal/v1/parts/@S@"))
(defroutes app
  (GET "/api/v1/shop/@S@" [] handler))
'''),
    "generic": ("kt/supplier_@S@.kt", '''import shop.core
class Depot@S@ {
  val n = 1
}
fun load@S@(id: Int) {
  http.post("https://dp.internal/v1/load/@S@")
}
task build@S@
  run
'''),
    "vue": ("vue/supplier_@S@.vue", '''<template><b/></template>
<script>
export function view@S@() {
  return 1;
}
</script>
'''),
    "notebook": ("nb/supplier_@S@.ipynb", '{"cells":[{"cell_type":"markdown","source":["x"]},{"cell_type":"code","source":["import os^","def cell@S@(x):^","    return x^"]},'
                 '{"cell_type":"code","source":"def solo@S@():^    return 2"}]}'),
}

# (language, name, type, first line, last line, route, method, consumed route, consumed method, host, imports)
EXPECTED = [
    ("python", "SupplierStore@S@", "class", 4, 7, None, None, None, None, None, "requests,shared.auth,shared.auth.check_token"),
    ("python", "load_part", "method", 5, 7, None, None, "/v1/suppliers/@S@/parts/{part}", "GET", "stock-@N@.internal", "requests,shared.auth,shared.auth.check_token"),
    ("python", "place_order_@S@", "endpoint", 10, 12, "/api/v1/suppliers/@S@/orders", "POST", None, None, None, "requests,shared.auth,shared.auth.check_token"),
    ("python", "total_@S@", "function", 14, 15, None, None, None, None, None, "requests,shared.auth,shared.auth.check_token"),
    ("broken_python", "broken_@S@", "function", 1, 4, None, None, None, None, None, None),
    ("broken_python", "Late@S@", "class", 3, 4, None, None, None, None, None, None),
    ("ts", "Order@S@", "interface", 2, 4, None, None, None, None, None, "@acme/api"),
    ("ts", "loadOrder@S@", "function", 5, 8, None, None, "/api/v1/suppliers/@S@/orders", "POST", "gw.internal", "@acme/api"),
    ("ts", "total@S@", "function", 9, 11, None, None, None, None, None, "@acme/api"),
    ("ts", "open", "function", 13, 15, None, None, "/v2/boxes/@S@", "PUT", None, "@acme/api"),
    ("go", "Server@S@", "class", 6, 8, None, None, None, None, None, "fmt,net/http"),
    ("go", "Health", "endpoint", 10, 12, "/api/v1/suppliers/@S@/health", "GET", None, None, None, "fmt,net/http"),
    ("go", "Sync@S@", "endpoint", 13, 15, "/api/v1/suppliers/@S@/health", "GET", "/v1/sync/@S@", "POST", "stock-@N@.internal", "fmt,net/http"),
    ("go", "Routes@S@", "endpoint", 16, 18, "/v1/suppliers/@S@", "DELETE", None, None, None, "fmt,net/http"),
    ("java", "SupplierApi@S@", "class", 2, 13, None, None, None, None, None, None),
    ("java", "listParts@S@", "endpoint", 5, 7, "/api/v1/suppliers/@S@/parts", "GET", None, None, None, None),
    ("java", "helper@S@", "method", 10, 12, None, None, None, None, None, None),
    ("php", "route_get_v1_suppliers_@S@_list", "endpoint", 3, 8, "/v1/suppliers/@S@/list", "GET", None, None, None, "Illuminate"),
    ("php", "Supplier@S@", "class", 4, 8, None, None, None, None, None, "Illuminate"),
    ("php", "push@S@", "method", 5, 7, None, None, "/v1/render/@S@", "POST", "pdf.internal", "Illuminate"),
    ("rust", "Store@S@", "class", 2, 4, None, None, None, None, None, "std::collections"),
    ("rust", "stock@S@", "endpoint", 6, 8, "/api/v1/suppliers/@S@/stock", "GET", "/v1/stock/@S@", "PUT", "wh.internal", "std::collections"),
    ("rust", "tail@S@", "function", 12, 12, None, None, None, None, None, "std::collections"),
    ("csharp", "Shop@S@", "class", 2, 12, None, None, None, None, None, "System.Net"),
    ("csharp", "Save@S@", "endpoint", 4, 6, "/api/v1/shops/@S@", "PUT", "/v1/carts/@S@", "DELETE", None, "System.Net"),
    ("csharp", "Noop@S@", "method", 10, 11, None, None, None, None, None, "System.Net"),
    ("ruby", "Shop@S@", "class", 2, 10, None, None, None, None, None, "json"),
    ("ruby", "Store@S@", "class", 3, 9, None, None, None, None, None, "json"),
    ("ruby", "push@S@", "method", 4, 8, None, None, "/v1/charge/@S@", "POST", "pay.internal", "json"),
    ("ruby", "route_get_v1_shop_@S@", "endpoint", 11, 13, "/v1/shop/@S@", "GET", None, None, None, "json"),
    ("c", "Shop@S@", "class", 3, 5, None, None, None, None, None, "stdio.h,shop.h"),
    ("c", "count@S@", "function", 6, 8, None, None, None, None, None, None),
    ("c", "fill@S@", "function", 10, 13, None, None, None, None, None, None),
    ("clojure", "fetch-part@S@", "function", 2, 3, None, None, "/v1/parts/@S@", "GET", "inv.internal", "shop.s@S@"),
    ("clojure", "route_get_api_v1_shop_@S@", "endpoint", 5, 5, "/api/v1/shop/@S@", "GET", None, None, None, "shop.s@S@"),
    ("generic", "Depot@S@", "class", 2, 4, None, None, None, None, None, "shop.core"),
    ("generic", "load@S@", "function", 5, 7, None, None, "/v1/load/@S@", "POST", "dp.internal", "shop.core"),
    ("generic", "build@S@", "function", 8, 9, None, None, None, None, None, "shop.core"),
    ("vue", "view@S@", "function", 3, 5, None, None, None, None, None, ""),
    ("notebook", "cell@S@", "function", 2, 3, None, None, None, None, None, "os"),
    ("notebook", "solo@S@", "function", 5, 6, None, None, None, None, None, "os"),
]

_COLUMNS = ("endpoint_route", "http_method", "consumes_endpoint", "consumes_http_method", "target_base_url", "imports")


def _filled(text: str | None) -> str:
    """An SQL expression for a template text."""
    if text is None:
        return "CAST(NULL AS STRING)"
    quoted = "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}").replace("\n", "~") + "'"
    quoted = f"replace(replace({quoted}, '@S@', CAST(s_suppkey AS STRING)), '@N@', lower(n_name))"
    return f"replace(replace({quoted}, '~', chr(10)), '^', concat(chr(92), 'n'))"


def service_files(langs: tuple[str, ...] = tuple(SERVICE_FILES)) -> str:
    """View text of ``(repo, file_path, content)`` for the chosen languages."""
    return " UNION ALL ".join(
        f"SELECT concat('svc_', lower(n_name)) AS repo, {_filled(SERVICE_FILES[lang][0])} AS file_path, {_filled(SERVICE_FILES[lang][1])} AS content "
        "FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey" for lang in langs)


def expected_symbols(langs: tuple[str, ...] = tuple(SERVICE_FILES)) -> str:
    """View text of the symbols those files hold."""
    rows = []
    for lang, name, kind, first, last, *rest in EXPECTED:
        if lang in langs:
            attrs = ", ".join(f"{_filled(v)} AS {c}" for c, v in zip(_COLUMNS, rest))
            rows.append(
                f"SELECT concat('svc_', lower(n_name)) AS repo, {_filled(SERVICE_FILES[lang][0])} AS file_path, {_filled(name)} AS symbol_name, "
                f"'{kind}' AS symbol_type, {first} AS start_line, {last} AS end_line, {attrs} FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey")
    return " UNION ALL ".join(rows)


ORDER_FILES = """
SELECT concat('web_', lower(n_name)) AS repo, concat('src/orders/o', CAST(l_orderkey AS STRING), '.ts') AS file_path,
       concat('import gateway from "svc_gateway";', chr(10), listagg(concat('export async function line_', CAST(r AS STRING), '() {{', chr(10),
         '  return fetch("/v1/suppliers/', CAST(l_suppkey AS STRING), '/parts/', CAST(l_partkey AS STRING), '");', chr(10), '}}', chr(10)), '') WITHIN GROUP (ORDER BY r)) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM {lineitem}) l
JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_name, l_orderkey
"""
ORDER_SYMBOLS = """
SELECT concat('web_', lower(n_name)) AS repo, concat('src/orders/o', CAST(l_orderkey AS STRING), '.ts') AS file_path,
       concat('line_', CAST(r AS STRING)) AS symbol_name, 'function' AS symbol_type, r * 3 - 1 AS start_line, r * 3 + 1 AS end_line,
       concat('/v1/suppliers/', CAST(l_suppkey AS STRING), '/parts/', CAST(l_partkey AS STRING)) AS consumes_endpoint, l_suppkey, l_partkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM {lineitem}) l
JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""


#: Services whose repositories can be imported, web clients in repositories of their own, and a tool that imports each service.
LINKED_FILES = f"""
SELECT CASE WHEN file_path LIKE 'web/%' THEN replace(repo, 'svc_', 'web_') ELSE repo END AS repo, file_path, content
FROM (SELECT replace(repo, ' ', '_') AS repo, file_path, content FROM ({service_files(("python", "ts"))}))
UNION ALL
SELECT concat('tool_', replace(lower(n_name), ' ', '_')), concat('jobs/total_', CAST(s_suppkey AS STRING), '.py'),
       replace(concat('from svc_', replace(lower(n_name), ' ', '_'), ' import total_', CAST(s_suppkey AS STRING), '~~def report_', CAST(s_suppkey AS STRING), '(x):~    return total_', CAST(s_suppkey AS STRING), '(x)~'), '~', chr(10))
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
"""
_LINKED = "SELECT replace(lower(n_name), ' ', '_') AS n, CAST(s_suppkey AS STRING) AS s FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"
#: The edges those files hold, by kind.
LINKED_EDGES = f"""
SELECT concat('web_', n, ':web/supplier_', s, '.ts:loadOrder', s, ':5') AS caller_id, concat('svc_', n, ':app/supplier_', s, '.py:place_order_', s, ':10') AS callee_id, 'consumes_api' AS edge_type, 1.0 AS confidence FROM ({_LINKED})
UNION ALL SELECT concat('tool_', n, ':jobs/total_', s, '.py:report_', s, ':3'), concat('svc_', n, ':app/supplier_', s, '.py:total_', s, ':14'), k.kind, k.confidence
FROM ({_LINKED}) CROSS JOIN (SELECT 'imports' AS kind, 0.98 AS confidence UNION ALL SELECT 'calls', 0.95) k
UNION ALL SELECT concat('svc_', n, ':app/supplier_', s, '.py:', replace(k.a, '@S@', s)), concat('svc_', n, ':app/supplier_', s, '.py:', replace(k.b, '@S@', s)), k.kind, 1.0
FROM ({_LINKED}) CROSS JOIN (SELECT 'SupplierStore@S@:4' AS a, 'load_part:5' AS b, 'defines' AS kind UNION ALL SELECT 'SupplierStore@S@:4', 'load_part:5', 'calls'
  UNION ALL SELECT 'place_order_@S@:10', 'load_part:5', 'calls' UNION ALL SELECT 'place_order_@S@:10', 'SupplierStore@S@:4', 'calls') k
"""


def code_files(spark: SparkSession, sf_dir: str, *langs: str) -> DataFrame:
    return views.view(spark, sf_dir, service_files(langs or tuple(SERVICE_FILES)))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, LINKED_FILES)


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, ORDER_FILES)
