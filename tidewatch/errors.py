"""The one exception type raised for refused inputs."""


class FlowDataError(ValueError):
    """An input table, argument or record breaks an operator's contract."""


def check_ratio(value, name, low=0.0, high=1.0):
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise FlowDataError(f"{name} must be a number, got {type(value).__name__}")
    if not low <= value <= high:
        raise FlowDataError(f"{name}={value} is outside [{low}, {high}]")
    return float(value)


def check_positive(value, name):
    if value < 1:
        raise FlowDataError(f"{name} must be at least 1, got {value}")
    return value


def need_columns(df, columns):
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise FlowDataError(f"table lacks column(s): {', '.join(absent)}")
    return df
