"""tapeloom: market-tape and news features as lazy Spark DataFrames.

Every public function takes DataFrames and returns a DataFrame; nothing is held
between calls.  Two kinds of rows are told apart throughout:

* *event rows* (trades, articles): any number per symbol.  They are only ever
  filtered, projected and aggregated with map-side partial aggregates, so a
  symbol owning a third of all rows is never gathered in one task.
* *panel rows*: one row per ``(symbol, date)``.  A symbol's series can never be
  longer than the calendar (36,525 rows for a century), which is what makes
  per-symbol windows safe at any data size.
"""
