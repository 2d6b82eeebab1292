"""Small frames and source trees for the tests."""

from __future__ import annotations

import os

from terravane.model import ENTITIES, RELATIONSHIPS

JAVA = "src/main/java/org/tidal/gauge/"
TREE = {
    JAVA + "TideDesk.java": """package org.tidal.gauge;
import java.util.List;
import org.springframework.web.bind.annotation.*;
@RequestMapping("/readings")
@RestController
class TideDesk {
  private TideLedger ledger;
  @GetMapping
  List<Receipt> recent(@RequestParam int hours) { return ledger.since(hours); }
  @PutMapping("/{gauge}")
  Receipt record(@PathVariable String gauge, @Valid @RequestBody Sounding sounding) {
    return gauge.isEmpty() ? null : ledger.enter(sounding);
  }
}
""",
    JAVA + "TideLedger.java": """package org.tidal.gauge;
import java.util.*;
@Service
public class TideLedger {
  private ReadingStore readings;
  private PressureFeed feed;
  private Alarm alarm;
  private final Chart chart = new Chart();
  public Receipt enter(Sounding sounding) {
    validateDepth(sounding);
    if (feed.stormAhead() && chart.isLow("north", 3)) {
      alarm.raise(sounding);
    }
    Reading next = fromSounding(sounding);
    readings.save(next);
    return receiptFor(next);
  }
  public List<Receipt> since(int hours) {
    List<Receipt> out = new ArrayList<>();
    for (Reading r : readings.findAll()) { if (hours > 0) out.add(receiptFor(r)); }
    return out;
  }
  private Reading fromSounding(Sounding sounding) { return new Reading(); }
  private Receipt receiptFor(Reading reading) { return new Receipt(); }
  private void validateDepth(Sounding sounding) { if (sounding == null) throw new IllegalArgumentException(); }
  private int springTide() { return 14; }
}
""",
    JAVA + "Chart.java": "package org.tidal.gauge;\nclass Chart { boolean isLow(String coast, int metres) { return metres < 4; } }\n",
    JAVA + "ReadingStore.java": "package org.tidal.gauge;\ninterface ReadingStore extends CrudRepository<Reading, String> { }\n",
    JAVA + "Reading.java": 'package org.tidal.gauge;\n@Entity\n@Table(name = "reading")\nclass Reading { private int level; private String coast; }\n',
    JAVA + "GaugeVisit.java": "package org.tidal.gauge;\n@Entity\nclass GaugeVisit { private String keeper; }\n",
    JAVA + "Archive.java": 'package org.tidal.gauge;\nclass Archive {\n  String yearly() { return ask("SELECT level FROM reading"); }\n  String near(String coast) { return ask("SELECT level FROM reading WHERE coast = " + coast); }\n  void prune() { ask("DELETE FROM old_tide"); }\n  void visited() { ask("INSERT INTO visit_log VALUES (2)"); }\n}\n',
    JAVA + "Sounding.java": "package org.tidal.gauge;\nclass Sounding { int fathoms; }\n",
    JAVA + "Receipt.java": "package org.tidal.gauge;\nclass Receipt { String number; }\n",
    JAVA + "Alarm.java": "package org.tidal.gauge;\ninterface Alarm { void raise(Sounding why); }\n",
    JAVA + "Siren.java": "package org.tidal.gauge;\nclass Siren implements Alarm { public void raise(Sounding why) { } }\n",
    JAVA + "Pager.java": "package org.tidal.gauge;\nclass Pager implements Alarm { public void raise(Sounding why) { } }\n",
    "db/schema.sql": "-- tides\nCREATE TABLE reading (level VARCHAR(8) NOT NULL, id BIGINT PRIMARY KEY);\nCREATE TABLE gauge (last BIGINT REFERENCES reading(id), code CHAR(3), PRIMARY KEY (code));\nALTER TABLE gauge ADD CONSTRAINT moored FOREIGN KEY (code) REFERENCES buoy(code);\n",
    "pom.xml": "<project><artifactId>tide-parent</artifactId><groupId>org.tidal</groupId><version>4</version></project>",
    "web/pom.xml": "<project><artifactId>tide-web</artifactId><parent><artifactId>tide-parent</artifactId><groupId>org.tidal</groupId><version>4</version></parent><dependencies><dependency><groupId>org.tidal</groupId><artifactId>tide-parent</artifactId></dependency><dependency><groupId>org.jdbi</groupId><artifactId>jdbi3-core</artifactId><version>3</version><scope>runtime</scope></dependency></dependencies></project>",
    "web/src/Boot.java": "class Boot { public static void main(String... words) { } }\n",
    "src/main/resources/application.properties": "feed.password=org.x.Y\ngauge.chart=org.tidal.gauge.Chart\nfeed.api.key=1\nport=80\n",
    "ada/irrigation.gpr": 'with "shared.gpr";\nproject Irrigation is\n   for Main use ("watering.adb");\nend Irrigation;\n',
    "ada/sensors.ads": "package Sensors is\n   type Moisture is record\n      Percent : Natural;\n   end record;\nend Sensors;\n",
    "ada/valves.ads": "with Sensors;\npackage Valves is\n   type Opening is record\n      Degrees : Natural;\n   end record;\n   Pressure : Integer := 0;\n   function To_Opening (Soil : Sensors.Moisture) return Opening;\n   procedure Turn (Wanted : Opening);\nend Valves;\n",
    "ada/valves.adb": 'with Pump_Link;\nwith Ada.Text_IO;\npackage body Valves is\n   Present : Opening;\n   function To_Opening (Soil : Sensors.Moisture) return Opening is\n      Half : Opening;\n   begin\n      return Half;\n   end To_Opening;\n   procedure Turn (Wanted : Opening) is\n   begin\n      if Pressure > 3 then\n         Pump_Link.Halt (Wanted);\n      end if;\n      Present := Wanted;\n      Ada.Text_IO.Put_Line ("turned");\n   end Turn;\nend Valves;\n',
    "ada/watering.adb": "with Valves;\nprocedure Watering is\n   Half : Valves.Opening;\nbegin\n   Valves.Pressure := 2;\n   Valves.Turn (Half);\nend Watering;\n",
    ".hidden/_private.properties": "a=b.c.Dee\n", "target/Skipped.java": "class Skipped { }\n", "data.bin": "\0\0",
}


def write_tree(root: str, tree: dict[str, str] = TREE) -> None:
    for p, c in tree.items():
        at = os.path.join(root, p)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(c)


def entities(spark, rows):
    """(id, kind, name, qualified name, attrs) rows."""
    return spark.createDataFrame([(i, k, n, q, "java", None, a) for i, k, n, q, a in rows], ENTITIES)


def edges(spark, rows):
    """(from, to, kind, status, attrs) rows; INFERRED and UNRESOLVED are not resolved unless attrs say so."""
    out = []
    for f, t, k, s, a in rows:
        a = dict(a)
        resolved = a.pop("resolved", s in ("RESOLVED", "DISCOVERED"))
        out.append((0, f, t, k, resolved, s, None, a))
    return spark.createDataFrame(out, RELATIONSHIPS)
