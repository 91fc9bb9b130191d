"""The SEG-Y record model: field tables, sample formats, character codes, labels."""

from __future__ import annotations

from dataclasses import dataclass

TEXT_BYTES, BINARY_BYTES, TRACE_BYTES = 3200, 400, 240
PREAMBLE = TEXT_BYTES + BINARY_BYTES
ROWS, COLUMNS = 40, 80

#: Default byte locations of the keys in a trace header.
ILINE, XLINE, OFFSET, X_COORD, Y_COORD = 189, 193, 37, 73, 77
START_TIME, SCALAR, SAMPLE_COUNT, SAMPLE_INTERVAL = 105, 71, 115, 117

#: Length codes: numpy type of a field (big-endian), and its Spark type. Codes 6, 68 and 200 are opaque bytes.
NUMPY = {1: "u1", 2: ">i2", 4: ">i4", 5: ">f4", 8: ">i8", 9: ">f8"}
SPARK = {1: "smallint", 2: "smallint", 4: "int", 5: "float", 8: "bigint", 9: "double"}
FORCED = {"int8": 1, "int16": 2, "int32": 4, "float32": 5, "int64": 8, "float64": 9}


@dataclass(frozen=True)
class Field:
    """A header field: 1-based byte location, name, length code, description."""

    loc: int
    name: str
    code: int
    description: str

    @property
    def opaque(self) -> bool:
        return self.code == 6 or self.code > 9

    @property
    def size(self) -> int:
        return self.code if self.opaque else int(self.numpy[-1])

    @property
    def numpy(self) -> str:
        # the counts at 313 and 321 of the binary header are integers under a code for doubles
        return ">i8" if self.name in ("num_traces", "byte_offset") else NUMPY[self.code]

    @property
    def spark(self) -> str:
        return "binary" if self.opaque else "bigint" if self.numpy == ">i8" else SPARK[self.code]


def _table(text: str) -> tuple[Field, ...]:
    rows = (line.split(" ", 3) for line in text.strip().splitlines())
    return tuple(Field(int(loc), name, int(code), description) for loc, name, code, description in rows)


# Location, name, length code and description of each field of the binary header.
BINARY = _table(
    """
1 jobID 4 Job ID
5 line_number 4 Line number
9 reel_number 4 Reel Number
13 num_traces_per_ensemble 2 N traces per ensembel
15 num_aux_traces_per_ensemble 2 N auxiliary traces per ensembel
17 sample_interval 2 Sample interval(dt)
19 sample_interval_orig 2 dt of original
21 trace_length 2 N samples per traces(ns)
23 trace_length_orig 2 ns of orignal
25 data_format 2 Data sample format code (1-IBM, 5-IEEE)
27 ensemble_fold 2 Ensemble fold
29 trace_sorting_code 2 Trace sorting code
31 v_sum_code 2 vertical sum code
33 sweep_freq_start 2 Sweep freq at start(Hz)
35 sweep_freq_end 2 Sweep freq at end(HZ)
37 sweep_length 2 Sweep length(ms)
39 sweep_type_code 2 Sweep type code
41 trace_num_sweep_channel 2 Trace number of sweep channel
43 sweep_trace_taper_start 2 Sweep trace taper length in ms at strat
45 sweep_trace_taper_end 2 Sweep trace taper length in ms at end
47 taper_type 2 Taper type
49 correlated_data_trace 2 Correlated data traces
51 bin_gain_recover 2 Binary gain recovered
53 amplitude_recover_method 2 Amplitude recovery method
55 measurement_system 2 Measurement system (units)
57 impulse_signal_polarity 2 Impulse signal polarity
59 vibratory_polarity_code 2 Vibratory polariy code
61 extend_num_data_tarces 4 Extended number of data traces per ensemble
65 extend_num_aux_data_tarces 4 Extended number of auxiliary traces per ensemble
69 extend_trace_length 4 Extended number of samples per data trace
73 extend_sample_intervel 9 Extended sample interval, IEEE double precision (64-bit)
81 extend_sample_intervel_orig 9 Extended sample interval of original field recording, IEEE double precision (64-bit)
89 extend_trace_length_orig 4 Extended number of samples per data trace in original recording
93 extend_ensement_fold 4 Extended ensemble fold
97 const_1 4 The integer constant 16909060_10 (01020304_16)
101 dummy 200 Unassigned
301 major_version 1 Major SEG-Y Format Revision Number. This is an 8-bit unsigned value
302 minor_version 1 Minor SEG-Y Format Revision Number. This is an 8-bit unsigned value with a radix point between the first and second bytes.
303 fixed_length_trace 2 Fixed length trace flag
305 extend_textual_header 2 Number of 3200-byte, Extended Textual File Header records following the Binary Header
307 max_extend_trace_header 4 Max number of additional 240-byte trace header
311 time_bias_code 2 Time basis code
313 num_traces 9 number of trace header in this file, 64-bit unsigned integer value
321 byte_offset 9 Byte offset of first trace relative to start of file or stream if known, otherwise zero. (64-bit unsigned integer value)
329 num_trailer_stanza 4 Number of 3200-byte data trailer stanza records following the last trace (4 byte signed integer).
333 dummy2 68 Unassigned
"""
)

# The same for the trace header.
TRACE = _table(
    """
1 trace_sequence_number_in_line 4 Trace sequence number within line
5 trace_sequence_number_in_file 4 Trace sequence number within SEG-Y file
9 orig_field_num 4 Original field record number
13 trace_num_in_orig 4 Trace number within the original field record
17 source_point_num 4 Energy source point number
21 ensemble_num 4 Ensemble number
25 trace_num_in_ensemble 4 Trace number within the ensemble
29 trace_ID_code 2 Trace identification code
31 num_v_summed_traces 2 Number of vertically summed traces yielding this trace
33 num_h_stacked_tarces 2 Number of horizontally stacked traces yielding this trace
35 data_used_for 2 Data use for
37 distance_from_center 4 Distance from center of the source point to the center of the receiver group
41 elevation_rev 4 Elevation of receiver group
45 surface_elevation_source 4 Surface elevation at source location
49 source_depth 4 Source depth below surface
53 seis_datum_elevation_rev 4 Seismic Datum elevation at receiver group
57 seis_datum_elevation_source 4 Seismic Datum elevation at source
61 water_col_height_source 4 Water column height at source location
65 water_col_height_rev 4 Water column height at receiver group location
69 scalar_for_elev_and_depth 2 Scalar to be applied to all elevations and depths
71 scalar_for_coord 2 Scalar to be applied to all coordinates
73 source_coord_X 4 Source coordinate - X
77 source_coord_Y 4 Source coordinate - Y
81 group_coord_X 4 Group coordinate - X
85 group_coord_Y 4 Group coordinate - Y
89 coord_units 2 Coordinate units
91 weather_vel 2 Weathering velocity
93 subweather_vel 2 Subweathering velocity
95 uphole_time_source 2 Uphole time at source in ms
97 uphole_time_rev 2 Uphole time at group in ms
99 source_static_corr 2 Source static correction in ms
101 group_static_corr 2 Group static correction in ms
103 total_static 2 Total static applied in ms
105 lag_time_A 2 Lag time A
107 lag_time_B 2 Lag Time B
109 delay_record_time 2 Delay recording time
111 mute_time_start 2 Mute time - Start time in ms
113 mute_time_end 2 Mute time - End time in ms
115 num_sample 2 Number of samples in this trace
117 sample_interval 2 Sample interval for this trace
119 gain_type 2 Gain type of field instruments
121 instrument_gain_constant 2 Instrument gain constant
123 instrument_early 2 Instrument gain constant
125 correlated 2 Correlated
127 sweep_freq_start 2 Sweep frequency at start
129 sweep_freq_end 2 Sweep frequency at end
131 sweep_length 2 Sweep length in ms
133 sweep_type_code 2 Sweep type
135 sweep_trace_taper_start 2 Sweep trace taper length at start in ms
137 sweep_trace_taper_end 2 Sweep trace taper length at end in ms
139 taper_type 2 Taper type
141 alias_filter_freq 2 Alias filter frequency (Hz)
143 alias_filter_slope 2 Alias filter slope (dB/octave)
145 notch_filter_freq 2 Notch filter frequency (Hz)
147 notch_filter_slope 2 Notch filter slope (dB/octave)
149 lowcut_freq 2 Low-cut frequency (Hz)
151 highcut_freq 2 High-cut frequency (Hz)
153 lowcut_scope 2 Low-cut slope (dB/octave)
155 highcut_scope 2 High-cut slope (dB/octave)
157 years 2 Year data recorded
159 day 2 Day of year
161 hour 2 Hour of day
163 minute 2 Minute of hour
165 secend 2 Second of minute
167 time_basis 2 Time basis code
169 trace_weight_factor 2 Trace weighting factor
171 geophone_roll 2 Geophone group number of roll switch position one
173 geophone_first 2 Geophone group number of trace number one within original field record
175 geophone_last 2 Geophone group number of last trace within original field record
177 gap_size 2 Gap size (total number of groups dropped)
179 down_or_up 2 Over travel associated with taper at beginning or end of line
181 X 4 X coordinate
185 Y 4 Y coordinate
189 inline_num 4 The in-line number
193 crossline_num 4 The cross-line number
197 shotpoint_num 4 Shotpoint number
201 scalar_for_shotpoint 2 Scalar to be applied to the shotpoint number
203 trace_value_measurement_uint 2 Trace value measurement unit
205 transduction 6 Transduction Constant
211 transduction_unit 2 Transduction Units
213 traceID 2 Device/Trace Identifier
215 scalar_for_95 2 Scalar to be applied to bytes 95-114
217 source_type 2 Source Type/Orientation
219 source_energy_direction 6 Source Energy Direction with respect to the source orientation
225 source_measurement 6 Source Measurement - Describes the source effort used to generate the trace
231 source_measu_unit 2 Source Measurement Unit
233 dummy 8 Either binary zeros or chars SEG00000
"""
)
BINARY_AT, TRACE_AT = {f.loc: f for f in BINARY}, {f.loc: f for f in TRACE}

#: Sample formats that can be read and written: code -> (numpy type, bytes); 10, 11 and 16 are unsigned.
FORMATS = {1: (">u4", 4), 2: (">i4", 4), 3: (">i2", 2), 5: (">f4", 4), 8: (">i1", 1), 10: (">u4", 4), 11: (">u2", 2), 16: (">u1", 1)}
# Labels of sample formats and of trace sortings.
FORMAT_LABELS = {
    1: "4-byte IBM floating-point", 2: "4-byte, two's complement integer", 3: "2-byte, two's complement integer",
    4: "4-byte fixed-point with gain (obsolete)", 5: "4-byte IEEE floating-point", 6: "8-byte IEEE floating-point",
    7: "3-byte two's complement integer", 8: "1-byte, two's complement integer", 9: "8-byte, two's complement integer",
    10: "4-byte, unsigned integer", 11: "2-byte, unsigned integer", 12: "8-byte, unsigned integer",
    15: "3-byte, unsigned integer", 16: "1-byte, unsigned integer",
}
SORTINGS = {
    -1: "Other", 0: "Unknown", 1: "As recorded (no sorting)", 2: "CDP ensemble", 3: "Single fold continuous profile",
    4: "Horizontally stacked", 5: "Common source point", 6: "Common receiver point", 7: "Common offset point",
    8: "Common mid-point", 9: "Common conversion point",
}
DTYPE_LABELS = {1: ">4f-ibm", 2: ">4i", 3: ">2i", 5: ">4f-ieee", 8: ">1i"}

# Characters of consecutive EBCDIC codes, from the first code of each run.
_EBCDIC = {
    64: " ", 75: ".<(+|", 80: "&", 90: "!$*);", 96: "-/", 106: "|,%_>?", 121: "`:#@'=\"", 129: "abcdefghi", 145: "jklmnopqr",
    161: "~stuvwxyz", 192: "{ABCDEFGHI", 208: "}JKLMNOPQR", 224: "\\", 226: "STUVWXYZ", 240: "0123456789",
}
EBCDIC = {first + k: c for first, run in _EBCDIC.items() for k, c in enumerate(run)}
#: Of two codes for a character the first counts.
TO_EBCDIC = {c: code for code, c in reversed(EBCDIC.items())}


def stack_class(sorting: int) -> str:
    """Whether a sorting code means stacked traces."""
    return "poststack" if sorting == 4 else "prestack" if sorting in (1, 2, 5, 6, 7, 8, 9) else "unspecified"
