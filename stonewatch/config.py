"""Tunables and fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

# Sensor kinds.
CRACK = "Fessurimetro"
RAIN = "Pluviometro"
THERMO = "Termometro"
HYGRO = "Igrometro"
ACCEL = "Accelerometro"
GYRO = "Giroscopio"

LOW_RATE = (CRACK, THERMO, RAIN, HYGRO)
HIGH_RATE = (ACCEL, GYRO)
SENSOR_KINDS = LOW_RATE + HIGH_RATE

# Opening kinds and orientations.
WINDOW = "Finestra"
DOOR = "Porta"
ORIENTATIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

# Risk kinds.
FLOOD_RISK = "Idrogeologico"
SEISMIC_RISK = "Sismico"

# Share of the threshold below which a sensor counts as fully healthy.
HEALTH_WEIGHT = {
    CRACK: Decimal("0.3"),
    RAIN: Decimal("0.5"),
    THERMO: Decimal("0.7"),
    HYGRO: Decimal("0.7"),
    ACCEL: Decimal("0.2"),
    GYRO: Decimal("0.2"),
}

# Advice when nothing is needed, and per sensor kind.
NO_ADVICE = "Non sono stati individuati interventi necessari"


@dataclass(frozen=True)
class AdviceRule:
    """When and what to advise for one kind of sensor."""

    prefix: str
    limit: int
    mild_text: str
    mild_importance: int
    severe_text: str
    severe_importance: int
    inclusive_drop: bool = False  # a drop of exactly 30 % counts


# Labels, limits, messages and importances of the advice.
ADVICE_RULES = {
    CRACK: AdviceRule(
        "Struttura - Muro: ",
        1,
        "Nell ultimo mese il diametro della crepa è aumentato, pur rimanendo sotto controllo. Si consiglia l'installazione di giunti per evitare interventi più invasivi in futuro",
        3,
        "Nell ultimo mese il diametro della crepa è aumentato notevolmente e non è più sotto controllo. Si consiglia l'immediato abbattimento e ricostruzione del muro",
        5,
        inclusive_drop=True,
    ),
    RAIN: AdviceRule(
        "Esterni - Pluviometro: ",
        1,
        "Nell'ultimo mese sono state rilevate precipitazioni superiori alla media, si consiglia l'intervento di un esperto per valutare la presenza di infiltrazioni",
        3,
        "Nell'ultimo mese sono state registrate precipitazioni senza precendeti, si consiglia l'intervento di un esperto per valutare la presenza di infiltrazioni ed il potenziamento della struttura isolante dell'edificio",
        4,
    ),
    THERMO: AdviceRule(
        "Interni - Sen. Temperatura: ",
        3,
        "Nell'ultimo mese la temperatura media è aumentata, pur restando sotto controllo. Si consiglia l'installazione di un impianto di climatizzazione",
        2,
        "Nell'ultimo mese la temperatura media è aumentata notevolmente e non è più sotto controllo. Si consiglia l'intervento di un esperto che controlli la coibentazione termica dell'edificio",
        4,
    ),
    HYGRO: AdviceRule(
        "Interni - Sen. Igrometro: ",
        5,
        "Nell'ultimo mese l'umidità media è aumentata, pur restando sotto controllo. Si consiglia l'impiego di deumidificatori per migliorare il comfort dell'edificio",
        2,
        "Nell'ultimo mese l'umidità media è aumentata notevolmente e non è più sotto controllo. Si consiglia l'intervento immediato di un esperto per evitare la formazione di muffe sulle pareti dell'edificio",
        3,
    ),
    ACCEL: AdviceRule(
        "Struttura - Accelerometro: ",
        3,
        "Nell'ultimo mese il sensore ha rilevato vibrazioni più intense della media. Si consiglia il sopralluogo di un esperto al fine di valutare l'integrità dei muri portanti e delle travi di sostegno",
        4,
        "L'integrità struttura dell'edificio è compromessa e deve essere messa in sicurezza da un esperto. Evacuare la struttura al più presto",
        5,
    ),
    GYRO: AdviceRule(
        "Struttura - Giroscopio: ",
        3,
        "Nell'ultimo mese il sensore ha rilevato vibrazioni più intense della media. Si consiglia il sopralluogo di un esperto al fine di valutare l'integrità dei solai ed il loro eventuale rifacimento",
        4,
        "L'integrità struttura dell'edificio è compromessa e deve essere messa in sicurezza da un esperto. Evacuare la struttura al più presto",
        5,
    ),
}


@dataclass(frozen=True)
class RiskClass:
    """Sensor kinds feeding one class of building risk and the area risk scaling it."""

    name: str
    kinds: tuple[str, ...]
    area_kind: str


ENVIRONMENTAL = RiskClass("environmental", (THERMO, RAIN, HYGRO), FLOOD_RISK)
STRUCTURAL = RiskClass("structural", (CRACK, ACCEL, GYRO), SEISMIC_RISK)
# As the reference behaves: gyroscopes never enter structural risk.
STRUCTURAL_WITHOUT_GYRO = RiskClass("structural", (CRACK, ACCEL), SEISMIC_RISK)


@dataclass(frozen=True)
class Periods:
    """Day offsets back from the calculation date: (start, end) of each closed window."""

    new: tuple[int, int]
    old: tuple[int, int]


# Windows, limits, rates, sizes and colours that results depend on.
@dataclass(frozen=True)
class Config:
    advice_periods: Periods = Periods(new=(15, 0), old=(30, 16))
    risk_periods: Periods = Periods(new=(16, 0), old=(30, 15))
    risk_classes: tuple[RiskClass, ...] = (ENVIRONMENTAL, STRUCTURAL)
    attenuation_km: int = 600
    max_shift_hours: int = 8
    max_concurrent_workers: int = 15
    base_pay: Decimal = Decimal("10")
    yearly_raise: Decimal = Decimal("1")
    base_crew: int = 8
    yearly_crew: Decimal = Decimal("0.5")
    svg_side: int = 600
    svg_offset: int = 5
    opening_colours: dict[str, str] = field(
        default_factory=lambda: {WINDOW: "#2ab2c7", DOOR: "#2ac776"}
    )
    other_opening_colour: str = "#c77e2a"
    sensor_colour: str = "#ff2b20"


DEFAULT = Config()
REFERENCE_RISK_CLASSES = (ENVIRONMENTAL, STRUCTURAL_WITHOUT_GYRO)
